"""Queries on token sequences: rendering, masks, splices, padding, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.operators import conversations as V
from benthos.operators import preparation as P
from benthos.operators import sequences as S
from benthos.plans.preparation import TURNS, _turns
from benthos.plans.registry import query
from benthos.sources.tables import table

PIECE = S.PIECE
_STYLES = {
    "two": ("'A chat. '", "CASE WHEN x.h THEN [{'x': 'USER: ' || x.v || ' ', 'y': false}] ELSE [{'x': 'ASSISTANT: ', 'y': false}, {'x': x.v || '</s>', 'y': true}] END"),
    "bare": ("E'<|im_start|>system\\nA chat.<|im_end|>'", "CASE WHEN x.h THEN [{'x': E'<|im_start|>user\\n' || x.v || '<|im_end|>', 'y': false}] ELSE [{'x': E'<|im_start|>assistant\\n', 'y': false}, {'x': x.v || '<|im_end|>', 'y': true}] END"),
    "llama": ("''", "CASE WHEN x.h THEN [{'x': '<s>[INST] ' || CASE WHEN i = 1 THEN E'<<SYS>>\\nA chat.\\n<</SYS>>\\n\\n' ELSE '' END || x.v || ' [/INST] ', 'y': false}] ELSE [{'x': x.v || ' </s>', 'y': true}] END"),
    "header": ("E'A chat.\\n\\n'", "[{'x': CASE WHEN x.h THEN '### Human: ' ELSE '### Assistant: ' END || x.v || E'\\n', 'y': NOT x.h}]"),
    "plain": ("'<image>'", "CASE WHEN x.h THEN [] ELSE [{'x': x.v || E'\\n', 'y': true}] END"),
}
EXPLODED = """, k AS (SELECT row_no, list_concat([{'x': @HEAD@, 'y': false}], flatten(list_transform(t, lambda x, i: @BODY@))) AS p FROM t),
z AS (SELECT row_no, flatten(list_transform(p, lambda a: list_transform(regexp_extract_all(a.x, '@PIECE@'), lambda w: {'token': w, 'told': a.y}))) AS z, len(regexp_extract_all(array_to_string(list_transform(p, lambda a: a.x), ''), '@PIECE@')) AS n FROM k)
SELECT row_no, pos::INT AS pos, z[pos + 1].token AS token, z[pos + 1].told AND len(z) = n AS told FROM (SELECT row_no, z, n, unnest(range(0, len(z))) AS pos FROM z)"""


def _masks(style: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        t = _turns(spark, d).withColumn("p", S.round_parts(F.col("t"), style))
        rows = t.select("row_no", F.posexplode(S.masked(F.col("p"), whole=S.text_of(F.col("p")))).alias("pos", "z"))
        return rows.select("row_no", "pos", "z.token", "z.told")

    f.__name__ = f"label_mask_{style}"
    return f


for _style, (_head, _body) in _STYLES.items():
    query(TURNS + EXPLODED.replace("@HEAD@", _head).replace("@BODY@", _body).replace("@PIECE@", PIECE))(_masks(_style))


GRID = "coalesce(num_tokens, 0) % 4 + 1"


@query(
    TURNS.replace("SELECT row_no, list_filter(conversations", f"SELECT row_no, {GRID} AS g, list_filter(conversations").replace("SELECT row_no, list_transform(c", "SELECT row_no, g, list_transform(c")
    + f""", k AS (SELECT row_no, list_concat([{{'x': E'<|im_start|>system\\nYou are a helpful assistant.<|im_end|>\\n', 'y': false}}], flatten(list_transform(t, lambda x: CASE WHEN x.h THEN [{{'x': E'<|im_start|>user\\n' || replace(x.v, '<image>', '<|vision_start|>' || repeat('<|image_pad|>', (g * 2)::BIGINT) || '<|vision_end|>') || E'<|im_end|>\\n', 'y': false}}] ELSE [{{'x': E'<|im_start|>assistant\\n', 'y': false}}, {{'x': x.v || E'<|im_end|>\\n', 'y': true}}] END))) AS p FROM t),
z AS (SELECT row_no, flatten(list_transform(p, lambda a: list_transform(regexp_extract_all(a.x, '{PIECE}'), lambda w: {{'token': w, 'told': a.y}}))) AS z FROM k)
SELECT row_no, pos::INT AS pos, z[pos + 1].token AS token, z[pos + 1].told AS told FROM (SELECT row_no, z, unnest(range(0, len(z))) AS pos FROM z)"""
)
def label_mask_visual(spark: SparkSession, d: str) -> DataFrame:
    """The rendering with visual tags (every picture of a record has the same grid here), token by token."""
    g = table(spark, d, "samples").select("row_no", (F.coalesce("num_tokens", F.lit(0)) % 4 + 1).alias("g"))
    t = _turns(spark, d).join(g, "row_no")
    n = F.greatest(F.lit(1), F.aggregate("t", F.lit(0), lambda s, x: s + F.size(F.split(x["value"], "<image>", -1)) - 1))
    shown = S.with_visual_tags(F.col("t"), F.array_repeat(F.col("g"), n))
    rows = t.select("row_no", F.posexplode(S.masked(S.visual_parts(shown))).alias("pos", "z"))
    return rows.select("row_no", "pos", "z.token", "z.told")


@query("WITH s AS (SELECT pred_no, string_split(prompt, '<image>') AS p FROM predictions WHERE prompt IS NOT NULL), e AS (SELECT pred_no, flatten(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN list_transform(regexp_extract_all(x, '" + PIECE + "'), lambda w: length(w)) ELSE list_concat(list_transform(range(0, 5), lambda k: -100::BIGINT), list_transform(regexp_extract_all(x, '" + PIECE + "'), lambda w: length(w))) END)) AS l FROM s) SELECT pred_no, pos::INT AS pos, l[pos + 1]::INT AS label FROM (SELECT pred_no, l, unnest(range(0, least(40, len(l)))) AS pos FROM e)")
def label_splice(spark: SparkSession, d: str) -> DataFrame:
    """Labels (here the lengths of a prompt's tokens) with five ignored ones for each picture, cut to forty."""
    p = table(spark, d, "predictions").where("prompt is not null").select("pred_no", S.pieces(F.col("prompt")).alias("w"))
    labels = F.transform("w", lambda x: F.length(x))
    rows = p.select("pred_no", F.posexplode(S.spliced_labels(labels, F.transform("w", lambda x: x == "<image>"), F.lit(5), most=40)).alias("pos", "label"))
    return rows


BATCHED = "(SELECT row_no, coalesce(num_tokens, 1) % 9 + 1 AS n, (row_number() OVER (ORDER BY row_no) - 1) // 8 AS batch FROM samples)"


@query(f"SELECT batch, list_concat([0], list(upto ORDER BY row_no))::INT[] AS bounds, flatten(list(ids ORDER BY row_no))::INT[] AS ids, list(n ORDER BY row_no)::INT[] AS lengths, max(n)::INT AS longest FROM (SELECT row_no, n, batch, sum(n) OVER (PARTITION BY batch ORDER BY row_no) AS upto, list_transform(range(1, (n + 1)::BIGINT), lambda k: (row_no * 7 + k) % 1000) AS ids FROM {BATCHED}) GROUP BY batch")
def packed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight records as one sequence, with its boundaries, and the lengths and the longest told from these."""
    s = table(spark, d, "samples").select("row_no", (F.coalesce("num_tokens", F.lit(1)) % 9 + 1).alias("n"))
    placed = V.chunk_places(s, "row_no").withColumn("batch", F.floor(F.col("place") / 8)).withColumn("ids", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: ((F.col("row_no") * 7 + k) % 1000).cast("int")))
    lengths = S.segment_lengths(F.col("bounds"))
    return S.packed(placed, "ids", "row_no", "batch").select("batch", "bounds", "ids", lengths.alias("lengths"), F.array_max(lengths).alias("longest"))


@query("WITH s AS (SELECT row_no, coalesce(num_tokens, 0) AS n FROM samples), f AS (SELECT row_no, list_concat(list_transform(range(0, (n % 3 + 1)::BIGINT), lambda k: (n % 2 + 1) * (n % 5 + 1)), list_transform(range(0, 2), lambda k: 6)) AS z FROM s) SELECT row_no, list_concat([0], list_transform(range(1, len(z) + 1), lambda i: list_sum(z[1:i])))::INT[] AS bounds FROM f")
def frame_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of the frames of two visual segments of each record."""
    n = F.coalesce("num_tokens", F.lit(0))
    seg = lambda t, h, w: F.struct(t.alias("t"), h.alias("h"), w.alias("w"))
    return table(spark, d, "samples").select("row_no", S.frame_bounds(F.array(seg(n % 3 + 1, n % 2 + 1, n % 5 + 1), seg(F.lit(2), F.lit(2), F.lit(3)))).alias("bounds"))


@query("SELECT row_no, axis::INT AS axis, k::INT AS k, CASE WHEN k < n THEN k * (axis + 1) ELSE 1 END::INT AS position FROM (SELECT row_no, coalesce(num_tokens, 0) % 12 + 1 AS n, unnest(range(0, 3)) AS axis FROM samples), range(0, 12) AS r(k)")
def padded_positions(spark: SparkSession, d: str) -> DataFrame:
    """Three axes of positions filled up with ones to the longest of twelve."""
    n = F.coalesce("num_tokens", F.lit(0)) % 12 + 1
    axis = lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda k: (k * (a + 1)).cast("int"))
    axes = F.array(*(axis(a) for a in range(3)))
    rows = table(spark, d, "samples").select("row_no", F.posexplode(S.padded_axes(axes, F.lit(12))).alias("axis", "a"))
    return rows.select("row_no", "axis", F.posexplode("a").alias("k", "position"))


@query(r"SELECT pred_no, regexp_replace(substr(text, 1, least(CASE WHEN instr(text, '. ') > 0 THEN instr(text, '. ') ELSE 1000000000 END, CASE WHEN instr(text, '###') > 0 THEN instr(text, '###') ELSE 1000000000 END, length(text) + 1)::INT - 1), '\s+$', '') AS text FROM predictions WHERE text IS NOT NULL")
def stop_cut(spark: SparkSession, d: str) -> DataFrame:
    """Answers up to the first stop word."""
    return table(spark, d, "predictions").where("text is not null").select("pred_no", S.until_stop(F.col("text"), [". ", "###"]).alias("text"))


@query("SELECT row_no, coalesce(len(image), 0)::INT AS n_images, n::INT AS n_tokens, coalesce(len(image), 0) = n AS fits FROM (SELECT row_no, image, coalesce(list_sum(list_transform(list_filter(conversations, lambda t: lower(t.speaker) IN ('human', 'user')), lambda t: (length(coalesce(t.value, '')) - length(replace(coalesce(t.value, ''), '<image>', ''))) // 7)), 0) AS n FROM samples)")
def request_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a request has as many pictures as image tokens: rows that haven't are the quarantine of S.quarantined."""
    from benthos.functions import text as T

    s = table(spark, d, "samples")
    n = F.coalesce(F.aggregate(F.filter("conversations", lambda t: F.lower(t["speaker"]).isin("human", "user")), F.lit(0), lambda a, t: a + T.media_tokens(t["value"])), F.lit(0))
    m = F.coalesce(F.size("image"), F.lit(0))
    m = F.when(F.col("image").isNull(), 0).otherwise(m)
    good, bad = S.quarantined(s.select("row_no", m.alias("n_images"), n.alias("n_tokens")), F.col("n_images") == F.col("n_tokens"))
    return good.withColumn("fits", F.lit(True)).unionByName(bad.withColumn("fits", F.lit(False)))


@query(f"WITH l AS (SELECT row_no, CASE WHEN coalesce(len(image) > 0, false) THEN 'picture' ELSE 'text' END AS pool FROM samples), n AS (SELECT pool, count(*) AS n FROM l GROUP BY 1), b AS (SELECT pool, unnest(range(0, n // 64)) AS megabatch, 64 AS n_rows FROM n UNION ALL SELECT 'rest', 0, sum(n % 64) FROM n) SELECT pool, megabatch::BIGINT AS megabatch, n_rows::BIGINT AS n_rows, n_rows::INT AS last_rank, true AS sorted FROM b WHERE n_rows > 0")
def modality_batches(spark: SparkSession, d: str) -> DataFrame:
    """The megabatches of pictured and of text records: their rows, and whether these go by falling length. The draw is seeded."""
    from pyspark.sql.window import Window

    lengths = P.lengths(table(spark, d, "samples")).select("row_no", F.when(F.col("modality_length") > 0, F.col("modality_length")).when(F.col("n_words") != F.col("length"), F.lit(0)).otherwise(F.least(F.col("modality_length"), F.lit(-1))).alias("x"))
    b = S.modality_batches(lengths, "row_no", "x", 64).join(lengths, "row_no")
    before = F.lag(F.abs("x")).over(Window.partitionBy("pool", "megabatch").orderBy("rank"))
    checked = b.withColumn("falls", F.coalesce(before >= F.abs("x"), F.lit(True)))
    return checked.groupBy("pool", "megabatch").agg(F.count(F.lit(1)).alias("n_rows"), F.max("rank").alias("last_rank"), F.min("falls").alias("sorted"))
