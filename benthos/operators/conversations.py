"""Conversations as training text: prompts in five styles, token lists with their masks, positions and packing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IGNORED, IMAGE = -100, -200


@dataclass(frozen=True)
class Template:
    """How turns are put together. style: single (one separator), two (separators in turn), bare (no colon), llama (instruction
    brackets), plain (values only)."""

    style: str
    system: str
    roles: tuple[str, str]
    sep: str
    sep2: str = ""


TEMPLATES = {
    "single": Template("single", "A chat.", ("Human", "Assistant"), "###"),
    "two": Template("two", "A chat.", ("USER", "ASSISTANT"), " ", "</s>"),
    "bare": Template("bare", "<|im_start|>system\nA chat.", ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>"),
    "llama": Template("llama", "A chat.", ("USER", "ASSISTANT"), "<s>", "</s>"),
    "plain": Template("plain", "", ("", ""), "\n", "\n"),
}


def rounds(conversations: Column) -> Column:
    """Turns (human, value) from the first human one on: roles by their names, image tokens moved to the front."""
    named = F.transform(conversations, lambda t: F.struct(F.lower(F.trim(t["speaker"])).isin("human", "user").alias("human"), F.coalesce(t["value"], F.lit("")).alias("value")))
    kept = F.filter(named, lambda t: t["human"].isNotNull())
    told = F.filter(F.zip_with(kept, conversations, lambda t, c: F.struct(t["human"].alias("human"), t["value"].alias("value"), F.lower(F.trim(c["speaker"])).alias("speaker"))), lambda t: t["speaker"].isin("human", "user", "gpt", "assistant"))
    first = F.array_position(F.transform(told, lambda t: t["human"]), True)
    return F.when(first > 0, F.transform(F.slice(told, first.cast("int"), F.greatest(F.size(told), F.lit(1))), lambda t: F.struct(t["human"].alias("human"), t["value"].alias("value"))))


def alternates(turns: Column) -> Column:
    """Whether human and other turns take turns, the human first."""
    return F.forall(F.transform(turns, lambda t, i: t["human"] == (i % 2 == 0)), lambda x: x)


def prompt(turns: Column, t: Template) -> Column:
    """The text of the turns; an empty value gives its role alone (nothing, where roles aren't shown)."""
    role = lambda h: F.when(h, t.roles[0]).otherwise(t.roles[1])
    text = lambda x: F.coalesce(x["value"], F.lit(""))
    sep = lambda i: F.when(i % 2 == 0, t.sep).otherwise(t.sep2)
    if t.style in ("single", "two"):
        end = (lambda i: F.lit(t.sep)) if t.style == "single" else sep
        parts = F.transform(turns, lambda x, i: F.when(text(x) != "", F.concat(role(x["human"]), F.lit(": "), text(x), end(i))).otherwise(F.concat(role(x["human"]), F.lit(":"))))
        return F.concat(F.lit(t.system + t.sep), F.array_join(parts, ""))
    if t.style == "bare":
        parts = F.transform(turns, lambda x: F.when(text(x) != "", F.concat(role(x["human"]), text(x), F.lit(t.sep))).otherwise(role(x["human"])))
        return F.concat(F.lit(t.system + t.sep), F.array_join(parts, ""))
    if t.style == "plain":
        return F.concat(F.lit(t.system), F.array_join(F.transform(turns, lambda x, i: F.when(text(x) != "", F.concat(text(x), sep(i))).otherwise("")), ""))
    told = F.lit(f"<<SYS>>\n{t.system}\n<</SYS>>\n\n") if t.system else F.lit("")
    parts = F.transform(
        turns,
        lambda x, i: F.when(text(x) == "", "")
        .when(i % 2 == 0, F.concat(F.lit(t.sep + "[INST] "), F.when(i == 0, told).otherwise(""), text(x), F.lit(" [/INST]")))
        .otherwise(F.concat(F.lit(" "), text(x), F.lit(" " + t.sep2))),
    )
    # characters of the first separator are taken off the front, whatever their order
    return F.regexp_replace(F.array_join(parts, ""), "^[" + "".join("\\" + c if not c.isalnum() else c for c in t.sep) + "]+", "")


def tokens(c: Column, vocabulary: int = 50_000) -> Column:
    """Stand-in token ids: a hash of each word. Any tokenizer that gives ARRAY<INT> can take its place."""
    return F.transform(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))


def splice_image(c: Column, bos: int = 1) -> Column:
    """Token ids of a text with IMAGE in place of each `<image>`, one bos in front."""
    parts = F.transform(F.split(c, "<image>", -1), lambda p, i: F.when(i == 0, tokens(p)).otherwise(F.concat(F.array(F.lit(IMAGE)), tokens(p))))
    return F.concat(F.array(F.lit(bos)), F.flatten(parts))


def double_images(ids: Column, token: int = IMAGE) -> Column:
    return F.flatten(F.transform(ids, lambda x: F.when(x == token, F.array(x, x)).otherwise(F.array(x))))


def labelled(turns: Column) -> Column:
    """(ids, labels) of the turns' tokens; those of human turns are ignored."""
    each = F.transform(turns, lambda t: F.struct(tokens(t["value"]).alias("ids"), t["human"].alias("h")))
    ids = F.flatten(F.transform(each, lambda t: t["ids"]))
    labels = F.flatten(F.transform(each, lambda t: F.when(t["h"], F.transform(t["ids"], lambda _: F.lit(IGNORED))).otherwise(t["ids"])))
    return F.struct(ids.alias("ids"), labels.alias("labels"))


def padded(a: Column, length: Column, fill: int) -> Column:
    """The first `length` elements, filled up to so many."""
    return F.concat(F.slice(a, F.lit(1), length), F.array_repeat(F.lit(fill), F.greatest(length - F.size(a), F.lit(0))))


def positions(mask: Column) -> Column:
    """The running count of ones, less one; 1 where the mask is 0."""
    start = F.struct(F.lit(-1).alias("n"), F.array().cast("array<int>").alias("p"))
    step = lambda a, m: F.struct((a["n"] + m.cast("int")).alias("n"), F.array_append(a["p"], F.when(m == 0, 1).otherwise(a["n"] + m.cast("int"))).alias("p"))
    return F.aggregate(mask, start, step, lambda a: a["p"])


def interleave(c: Column) -> Column:
    """Text parts and numbers of images, in turn: `t:…` and `i:k`; white space beside an image token goes."""
    parts = F.split(F.regexp_replace(c, r"\s*<image>\s*", "<image>"), "<image>", -1)
    return F.filter(F.flatten(F.transform(parts, lambda p, i: F.array(F.concat(F.lit("t:"), p), F.concat(F.lit("i:"), i.cast("string"))))), lambda x: (x != "t:") & ~x.rlike("^i:") | x.rlike("^i:"))


def grid_positions(kinds: Column) -> Column:
    """The 3-axis positions of a sequence of segments (text of n tokens: t = 0; a picture of t x h x w cells): text moves all
    axes together, a picture's cells get their own t, h and w from the position after the last one."""
    text = lambda n, at: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k + at).alias("t"), (k + at).alias("h"), (k + at).alias("w")))
    cell = lambda s, at: F.transform(F.sequence(F.lit(0), s["t"] * s["h"] * s["w"] - 1), lambda k: F.struct((at + (k / (s["h"] * s["w"])).cast("int")).alias("t"), (at + (k / s["w"]).cast("int") % s["h"]).alias("h"), (at + k % s["w"]).alias("w")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<t:int,h:int,w:int>>").alias("p"))

    def step(acc, s):
        new = F.when(s["t"] == 0, text(s["n"], acc["at"])).otherwise(cell(s, acc["at"]))
        move = F.when(s["t"] == 0, s["n"]).otherwise(F.greatest(s["t"], s["h"], s["w"]))
        return F.struct((acc["at"] + move).alias("at"), F.concat(acc["p"], new).alias("p"))

    return F.aggregate(kinds, start, step, lambda a: a["p"])


def pack_batches(df: DataFrame, length: str, order: str, batch: int, group: str = "batch") -> DataFrame:
    """df in batches of `batch` rows by their place in `order`, with each row's first and last boundary in its packed batch.
    The place is found by salted parts, not in one task."""
    placed = chunk_places(df, order).withColumn(group, F.floor(F.col("place") / batch))
    w = Window.partitionBy(group).orderBy("place")
    upto = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumns({"to_token": upto, "from_token": upto - F.col(length)})


def chunk_places(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """df with its 0-based place in `order` (a unique number): ranges of the order are counted, then each is ranked on its own."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn("place", F.lit(0).cast("long")).limit(0)
    step = max(1, -(-(high - low + 1) // parts))
    cut = df.withColumn("_part", F.floor((F.col(order) - F.lit(low)) / step))
    before = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return cut.join(F.broadcast(before), "_part").withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")).drop("_part", "_before")
