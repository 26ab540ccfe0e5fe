"""Conversations as token sequences: rendered with headers, visual tags or templates, masked to what is learned, spliced, padded
and packed. A tokenizer is any function of a text column to an array column; the default cuts words, marks and special tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Tokenizer = Callable[[Column], Column]
#: Fixed value: what a token is to the default tokenizer: a special token, a word of letters and digits, or another sign.
PIECE = r"<\|[a-z_]+\|>|</?s>|<image>|\[/?INST\]|[\p{L}\p{N}]+|[^\s\p{Z}\x{0085}\x{000b}\p{L}\p{N}]"


def pieces(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))


def part(text: Column, told: Column | bool) -> Column:
    """A stretch of a sequence: its text, and whether it is learned."""
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), (F.lit(told) if isinstance(told, bool) else told).alias("told"))


def masked(parts: Column, tokenizer: Tokenizer = pieces, whole: Column | None = None) -> Column:
    """Array of (token, told) of the parts' tokens. whole: the text that the parts make up; if its own tokens are more or fewer, the
    parts' borders can't be trusted and nothing is learned."""
    each = F.flatten(F.transform(parts, lambda p: F.transform(tokenizer(p["text"]), lambda x: F.struct(x.alias("token"), p["told"].alias("told")))))
    if whole is None:
        return each
    return F.when(F.size(each) == F.size(tokenizer(whole)), each).otherwise(F.transform(each, lambda x: F.struct(x["token"].alias("token"), F.lit(False).alias("told"))))


def round_parts(turns: Column, style: str, system: str = "A chat.") -> Column:
    """The parts of a conversation (turns of human, value): answers and what ends them are learned.

    two: `USER: q ASSISTANT: a</s>`; bare: `<|im_start|>user\\nq<|im_end|><|im_start|>assistant\\na<|im_end|>`; llama:
    `<s>[INST] q [/INST] a </s>` with the system text in the first; header: `### Human: q\\n### Assistant: a\\n`; plain: the image
    token, then the last value."""
    value = lambda t: F.coalesce(t["value"], F.lit(""))
    if style == "two":
        head = part(F.lit(system + " "), False)
        body = F.transform(turns, lambda t: F.when(t["human"], F.array(part(F.concat(F.lit("USER: "), value(t), F.lit(" ")), False))).otherwise(F.array(part(F.lit("ASSISTANT: "), False), part(F.concat(value(t), F.lit("</s>")), True))))
    elif style == "bare":
        head = part(F.lit(f"<|im_start|>system\n{system}<|im_end|>"), False)
        body = F.transform(turns, lambda t: F.when(t["human"], F.array(part(F.concat(F.lit("<|im_start|>user\n"), value(t), F.lit("<|im_end|>")), False))).otherwise(F.array(part(F.lit("<|im_start|>assistant\n"), False), part(F.concat(value(t), F.lit("<|im_end|>")), True))))
    elif style == "llama":
        head = part(F.lit(""), False)
        told = F.lit(f"<<SYS>>\n{system}\n<</SYS>>\n\n")
        body = F.transform(turns, lambda t, i: F.when(t["human"], F.array(part(F.concat(F.lit("<s>[INST] "), F.when(i == 0, told).otherwise(""), value(t), F.lit(" [/INST] ")), False))).otherwise(F.array(part(F.concat(value(t), F.lit(" </s>")), True))))
    elif style == "header":
        head = part(F.lit(system + "\n\n"), False)
        body = F.transform(turns, lambda t: F.array(part(F.concat(F.when(t["human"], "### Human: ").otherwise("### Assistant: "), value(t), F.lit("\n")), ~t["human"])))
    elif style == "plain":
        head = part(F.lit("<image>"), False)
        body = F.transform(F.filter(turns, lambda t: ~t["human"]), lambda t: F.array(part(F.concat(value(t), F.lit("\n")), True)))
    else:
        raise ValueError(f"no such style: {style}")
    return F.concat(F.array(head), F.flatten(body))


def text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def with_visual_tags(turns: Column, grids: Column, tag: str = "<image>", pad: str = "<|image_pad|>") -> Column:
    """Turns with the k-th visual tag of all human turns replaced by a start, grids[k] pads twice over, and an end. A tag beyond the grids
    gives an empty pair."""
    start, end = F.lit("<|vision_start|>"), F.lit("<|vision_end|>")
    parts = lambda t: F.split(F.coalesce(t["value"], F.lit("")), tag, -1)
    before = lambda i: F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0), lambda s, u: s + F.when(u["human"], F.size(parts(u)) - 1).otherwise(0))
    fill = lambda k: F.concat(start, F.repeat(F.lit(pad), F.coalesce(F.get(grids, k), F.lit(0)) * 2), end)

    def shown(t, i):
        told = F.transform(parts(t), lambda p, k: F.when(k == 0, p).otherwise(F.concat(fill(before(i) + k - 1), p)))
        return F.struct(t["human"].alias("human"), F.when(t["human"], F.array_join(told, "")).otherwise(F.coalesce(t["value"], F.lit(""))).alias("value"))

    return F.transform(turns, shown)


def visual_parts(turns: Column, system: str = "You are a helpful assistant.") -> Column:
    """Parts of a rendering in which the first three tokens of each answer (its start, its role and the line break) aren't learned."""
    line = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))
    body = F.transform(turns, lambda t: F.when(t["human"], F.array(part(line("user", t["value"]), False))).otherwise(F.array(part(F.lit("<|im_start|>assistant\n"), False), part(F.concat(t["value"], F.lit("<|im_end|>\n")), True))))
    return F.concat(F.array(part(line("system", F.lit(system)), False)), F.flatten(body))


def spliced_labels(labels: Column, image: Column, width: Column, ignored: int = -100, most: int | None = None) -> Column:
    """Labels with `width` ignored ones in place of each element that `image` marks, cut to `most`."""
    out = F.flatten(F.transform(F.arrays_zip(labels.alias("l"), image.alias("i")), lambda z: F.when(z["i"], F.array_repeat(F.lit(ignored), width)).otherwise(F.array(z["l"]))))
    return out if most is None else F.slice(out, 1, most)


def packed(df: DataFrame, tokens: str, order: str, group: str) -> DataFrame:
    """(group, ids, bounds): the tokens of each batch in a row, and where each record begins, and the end. A batch is of bounded size."""
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, tokens))).alias("_r"))
    sizes = F.transform("_r", lambda r: F.size(r[tokens]))
    bounds = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    return rows.select(group, F.flatten(F.transform("_r", lambda r: r[tokens])).alias("ids"), bounds.alias("bounds"))


def segment_lengths(bounds: Column) -> Column:
    """The differences of neighbouring boundaries."""
    return F.zip_with(F.slice(bounds, F.lit(2), F.size(bounds) - 1), F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, a: b - a)


def frame_bounds(grids: Column) -> Column:
    """Boundaries of the frames of visual segments (t, h, w): each frame has h x w cells."""
    sizes = F.flatten(F.transform(grids, lambda g: F.array_repeat(g["h"] * g["w"], g["t"])))
    return F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))


def padded_axes(axes: Column, length: Column, fill: int = 1) -> Column:
    """Each axis of positions filled up to a length."""
    return F.transform(axes, lambda a: F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), length - F.size(a)))))


def until_stop(c: Column, stops: list[str]) -> Column:
    """The text before the first of the stop words, white space after it taken off."""
    first = F.least(*(F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops), F.length(c) + 1)
    return F.regexp_replace(F.substring(c, F.lit(1), first - 1), r"\s+$", "")


def quarantined(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that can be used, and those that can't: in place of trying again and taking the next one."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def modality_batches(df: DataFrame, key: str, length: str, batch: int, seed: int = 1) -> DataFrame:
    """(key, pool, megabatch, rank): rows with and without pictures (sign of `length`) in seeded random megabatches of their own, the
    longest first in each; the last, partial megabatches of both pools make up one more. Pools are dealt by hash ranges, not sorted
    whole."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20))
    pools = df.withColumns({"pool": F.when(F.col(length) >= 0, "picture").otherwise("text"), "_h": h, "_part": F.shiftright(h, 12)})
    counts = pools.groupBy("pool", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("pool").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("pool")
    offsets = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)}).drop("_n")
    ranked = pools.join(F.broadcast(offsets), ["pool", "_part"]).withColumn("_k", F.row_number().over(Window.partitionBy("pool", "_part").orderBy("_h", key)) - 1 + F.col("_before"))
    full = F.floor(F.col("_k") / batch) < F.floor(F.col("_all") / batch)
    placed = ranked.withColumns({"pool": F.when(full, F.col("pool")).otherwise("rest"), "megabatch": F.when(full, F.floor(F.col("_k") / batch)).otherwise(F.lit(0))})
    rank = F.row_number().over(Window.partitionBy("pool", "megabatch").orderBy(F.desc(F.abs(length)), key))
    return placed.select(key, "pool", "megabatch", rank.alias("rank"))
