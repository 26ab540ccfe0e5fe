"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Task of the second character of an id.
TASKS = {"0": "Image_caption", "1": "Grounding", "2": "Region_caption", "3": "VQA", "4": "Fishnet_Classification", "5": "Detection", "6": "Counting", "7": "Region_Classification"}


def tag(id_: Column) -> Column:
    return F.substring(id_, 2, 1)


def task(id_: Column) -> Column:
    """The task that an id's tag names; null for an unknown tag."""
    return F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv))[tag(id_)]


def strip(c: Column) -> Column:
    """White space of any script taken off both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normal_label(c: Column) -> Column:
    return F.lower(strip(c))


def drop_trailing_signs(c: Column) -> Column:
    """Trailing characters that are no letters or digits, of any script, taken off."""
    return F.regexp_replace(c, r"(?U)[\W_]+$", "")


def whole_number(c: Column) -> Column:
    """The integer that a text is, white space around it aside; null for anything else."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]{1,18}$"), F.try_to_number(F.regexp_replace(s, r"^\+", ""), F.lit("S999999999999999999")).cast("bigint"))


def word_count(c: Column) -> Column:
    """Pieces between white space; 0 for null and blank."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def media_tokens(c: Column, token: str = "<image>") -> Column:
    """How often the token stands in the text."""
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("int"), F.lit(0))


def without_image(c: Column) -> Column:
    return strip(F.replace(c, F.lit("<image>"), F.lit("")))


def with_image_first(c: Column) -> Column:
    """The image token, wherever it stands in the text, moved to the front on a line of its own; other texts as they are."""
    return F.when(c.contains("<image>"), F.concat(F.lit("<image>\n"), without_image(c))).otherwise(c)


def null_like(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin("nan", "none", "")


def until_null_like(options: Column) -> Column:
    """The options before the first null-like one."""
    first = F.array_position(F.transform(options, null_like), True)
    return F.when(first > 0, F.slice(options, F.lit(1), (first - 1).cast("int"))).otherwise(options)


def rotated(options: Column, by: Column) -> Column:
    return F.concat(F.slice(options, by + 1, F.size(options)), F.slice(options, F.lit(1), by))


#: Fixed value: the instruction after the options.
ONE_LETTER = "Answer with the option’s letter from the given choices directly."


def mcq_prompt(hint: Column, question: Column, options: Column) -> Column:
    """Hint (unless null-like), question, lettered options and the instruction, a line each."""
    lettered = F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x))
    return F.concat_ws("\n", F.when(~null_like(hint), hint), question, F.array_join(lettered, "\n"), F.lit(ONE_LETTER))


def yes_or_no(c: Column) -> Column:
    """no, if the first sentence, commas aside, has one of the words No, not or no; else yes."""
    words = F.split(F.replace(F.substring_index(c, ".", 1), F.lit(","), F.lit("")), " ")
    return F.when(F.arrays_overlap(words, F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def option_letter(c: Column) -> Column:
    """The option that an answer names: itself, `X. …`, or the only `The answer is X`; FAILED otherwise."""
    found = F.regexp_extract_all(c, F.lit(r"The answer is ([A-Z])."), 1)
    return F.when(c.rlike(r"^[A-E]\z"), c).when(c.rlike(r"(?s)^[A-E]\. "), F.substring(c, 1, 1)).when(F.size(found) == 1, F.element_at(found, 1)).otherwise("FAILED")


def score_pair(c: Column) -> Column:
    """The two numbers of the first line, parted by a space or comma; [-1, -1] unless it has exactly two."""
    parts = F.split(F.replace(F.substring_index(c, "\n", 1), F.lit(","), F.lit(" ")), " ")
    pair = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(pair) == 2) & ~F.exists(pair, lambda x: x.isNull()), pair).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def question_of_prompt(c: Column) -> Column:
    """The question, in lower case, of a prompt in one of three shapes; null for another shape."""
    lines = F.split(c, "\n")
    shape = (
        F.when(c.startswith("OCR tokens: "), F.regexp_extract(c, r"(?s)Question: (.*?) Short answer:", 1))
        .when(c.contains("Reference OCR token: ") & (F.size(lines) == 3), F.when(c.startswith("Reference OCR token:"), F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0))))
        .when(F.size(lines) == 2, F.get(lines, F.lit(0)))
    )
    return F.lower(shape)


def model_name(path: Column) -> Column:
    """The last part of a path; of a checkpoint, with the part before it."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-"), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)


#: Spellings of the answer normaliser.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've",
    "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am",
    "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't",
    "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't",
    "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't", "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's",
    "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's",
    "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've",
    "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd",
    "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've",
    "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
#: Number words, articles and signs of the answer normaliser.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
SIGNS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
#: Only so many full stops are taken out of one answer.
MOST_STOPS = 32


def normal_answer(c: Column) -> Column:
    """A free answer made comparable: lower case, punctuation (a sign beside a space goes, any other becomes one), full stops not
    before a digit (the first 32), articles, number words, contractions."""
    s = strip(F.replace(F.replace(F.replace(F.lower(c), F.lit(","), F.lit("")), F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" 's")))
    s = strip(F.translate(s, "\n\t", "  "))
    out = s
    for sign in SIGNS:
        beside = s.contains(sign + " ") | s.contains(" " + sign)
        out = F.replace(out, F.lit(sign), F.when(beside, F.lit("")).otherwise(F.lit(" ")))
    pieces = F.split(out, r"\.(?!\d)")
    head = F.array_join(F.slice(pieces, 1, MOST_STOPS + 1), "")
    tail = F.when(F.size(pieces) > MOST_STOPS + 1, F.concat(F.lit("."), F.array_join(F.slice(pieces, MOST_STOPS + 2, 1 << 20), "."))).otherwise("")
    words = F.filter(F.split(F.lower(F.concat(head, tail)), r"(?U)\s+"), lambda w: w != "")
    spelt = F.create_map(*(F.lit(x) for kv in (CONTRACTIONS | NUMBER_WORDS).items() for x in kv))
    kept = F.filter(F.transform(words, lambda w: F.when(w.isin(*NUMBER_WORDS), spelt[w]).otherwise(w)), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(spelt[w], w)), " ")
