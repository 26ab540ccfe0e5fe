"""Several values packed in one field (problem 2): the delimiters of each source inferred from all its rows, then one row per
value with its position.

Candidates come from the data: any mark between two words (a run of characters that are no letters or digits, told apart by
whether a space stands before it) and any short word between two others. A row gives a candidate its piece count against the
pieces that all marks of the row make, and the pieces at its sides that are of one type (box, measure, Han text, other text). A
mark that stands equally often in all three or more pieces of another one, or without spaces in a row that has marks with spaces, belongs to
the values and counts against itself. A source's score of a candidate is its share of the row's cuts times the share of equal
types at its sides, both summed over the source's rows and shrunk to the figures of all sources by a few cuts; candidates that
reach ACCEPT (words: ACCEPT_WORD) are what the source's rows are split by. A row may use several."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benthos.operators.skew import hot_split_join
from benthos.session import durable, ship_code

#: Least score of a mark and of a word.
ACCEPT, ACCEPT_WORD = 0.4, 0.6
#: Cuts of all sources that a source's figures are filled up with.
SHRINK = 20.0
#: Letters of a word that may be a delimiter, at most.
WORD = 5
#: A mark's name is at most so long; rows with longer ones don't propose them.
MARK = 8

_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "'": "'"}
_BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】"}
_ENDS = {v: k for k, v in _BRACKETS.items()}
_SPECIAL = regex.compile("[" + regex.escape("".join({*_QUOTES, *_QUOTES.values(), *_BRACKETS, *_ENDS})) + "\n]")
_DECIMAL = regex.compile(r"(?<=\d),(?=\d)")
_NUMBERING = regex.compile(r"(?<![\w.,])\d{1,3}[.)](?=\s)")
_BULLET = regex.compile(r"^(?:[-*•·–—]\s+|\(\d{1,3}\)\s*|\d{1,3}[.)]\s+)")
#: Joining words that may stand before a value.
_JOIN = regex.compile(r"^(?:(?:and|or|und|oder|y|o|et|ou|и|или)\s+|[和及与])(?=\S)", regex.I)
_PIECE_END = regex.compile(r"[^\S\n\t]*(?:[^\w\s]|[\n\t]|\Z)")
_TOKEN = regex.compile(r"[\w\p{M}]+|[^\w\p{M}]+")
_CORE = regex.compile(r"[^\w\s.\"“”„«»‘’'()\[\]{}（）【】][^\w\s\"“”„«»‘’'()\[\]{}（）【】]*|\.(?=\s)")
_HAN = regex.compile(r"\p{Han}")


def protected(s: str) -> bytearray:
    """1 for each character of s that can't part values: in quotes or brackets, or a comma within a number.

    A double quotation mark opens anywhere, a single one where no letter or digit stands before it; it closes at its partner, a
    doubled partner stands for itself, and a single one closes only before a mark or the end. A mark or bracket without a partner
    is an ordinary character; brackets close on their line."""
    out, ends = bytearray(len(s)), _brackets(s)
    for m in _DECIMAL.finditer(s):
        out[m.start()] = 1
    done, lone = 0, set()
    for m in _SPECIAL.finditer(s):
        i, c = m.start(), m[0]
        if i < done or c == "\n":
            continue
        end = -1
        if c in _QUOTES and c not in lone and (c in '"“«„' or i == 0 or not (s[i - 1].isalnum())):
            end = _closing(s, i, _QUOTES[c], single=c in "'‘")
            if end == -1:  # nor has any later one of its kind
                lone.add(c)
        elif c in _BRACKETS:
            end = ends.get(i, -1)
        if end > i:
            out[i : end + 1] = b"\1" * (end + 1 - i)
            done = end + 1
    return out


def _closing(s: str, at: int, mark: str, single: bool) -> int:
    """Where the quotation that opens at `at` closes; -1 if it doesn't, -2 if nothing is in it."""
    i = at + 1
    while (i := s.find(mark, i)) >= 0:
        if s[i + 1 : i + 2] == mark and mark != "”" and i > at + 1:  # doubled
            i += 2
            continue
        if not single or _PIECE_END.match(s, i + 1):
            return i if i > at + 1 else -2
        i += 1
    return -1


def _brackets(s: str) -> dict[int, int]:
    """Where each bracket that is closed on its line is closed."""
    stack, ends = [], {}
    for m in _SPECIAL.finditer(s):
        c = m[0]
        if c in _BRACKETS:
            stack.append((m.start(), _BRACKETS[c]))
        elif c == "\n":
            stack.clear()
        elif stack and c == stack[-1][1]:
            ends[stack.pop()[0]] = m.start()
    return ends


def masked(s: str) -> str:
    """s with each protected character, and the numbering of pieces, made a letter."""
    hidden = protected(s)
    if any(hidden):
        s = "".join("q" if h else c for c, h in zip(s, hidden))
    return _NUMBERING.sub(lambda m: "q" * len(m[0]), s)


def marks(text: str, edges: bool = False) -> list[tuple[str, int, int, bool]]:
    """(name, from, to, tight) of each mark between two words of a masked text, and at its edges if asked for. The name has a space
    in front if the text has one there; a mark repeated is one. tight: neither side has a space."""
    found, tokens = [], list(_TOKEN.finditer(text))
    for k, m in enumerate(tokens):
        run = m[0]
        if run[0].isalnum() or run[0] == "_" or run == " " or not (edges or 0 < k < len(tokens) - 1):
            continue
        if "\n" in run or "\t" in run:
            name, tight = "\n" if "\n" in run else "\t", False
            a, b = m.start() + min(x for x in (run.find("\n"), run.find("\t")) if x >= 0), m.start() + max(run.rfind("\n"), run.rfind("\t")) + 1
        else:
            core = _CORE.search(run)
            if not core:
                continue
            name = core[0].rstrip(".") or "."
            a, b = m.start() + core.start(), m.start() + core.start() + len(name)
            if len(set(name)) == 1:  # repeated, with spaces or not
                while b < m.end() and text[b] in name[0] + " ":
                    b += 1
                b = a + len(text[a:b].rstrip())
                name = name[0]
            tight = a > 0 and not text[a - 1].isspace() and not text[b : b + 1].isspace()
            if a > m.start() and text[a - 1].isspace():
                name = " " + name
        found.append((name, a, b, tight))
    return found


def inner_words(piece: str) -> tuple[list[str], list[str]]:
    """The short words between two others, and those at an end of the piece."""
    words = piece.lower().split()
    short = [len(w) <= WORD and w.isalpha() and not _HAN.search(w) for w in words]
    return [w for w, x in zip(words[1:-1], short[1:-1]) if x], [w for k, (w, x) in enumerate(zip(words, short)) if x and k in (0, len(words) - 1)]


def clean(piece: str) -> str:
    """The value as written: trimmed, without bullet or number, joining word, closing full stop and enclosing quotes."""
    s = _BULLET.sub("", piece.strip().lstrip("\u200b\ufeff")).strip()
    s = _JOIN.sub("", s).strip()
    if s.endswith(("。", ".")) and not s.endswith(".."):
        s = s[:-1].rstrip()
    if len(s) > 1 and s[0] in _QUOTES and s[-1] == _QUOTES[s[0]] and _closing(s, 0, s[-1], single=s[0] in "'‘") == len(s) - 1:
        mark = s[-1]
        s = s[1:-1].replace(mark * 2, mark).strip()
    return s


def kind(piece: str) -> str:
    s = clean(piece)
    return "box" if s[:1] in ("[", "{") else "measure" if s[:1].isdigit() or (s[:1] in "+-" and s[1:2].isdigit()) else "han" if _HAN.search(s) else "text"


def score_row(s: str) -> dict[str, tuple[float, float, float]]:
    """What the row gives each candidate in it: its cuts that can part values, all cuts it is held against, and its cuts between
    pieces of one type. Words also count at the ends of pieces, as cuts that aren't theirs."""
    text = masked(s)
    found = marks(text)
    n = len(found)
    ends = [0, *(b for _, _, b, _ in found)]
    pieces = [s[a : found[k][1]] if k < n else s[a:] for k, a in enumerate(ends)]
    kinds = [kind(p) for p in pieces]
    loose = any(not tight for _, _, _, tight in found)
    names = [f[0] for f in found]
    inner = set()
    for d in set(names):
        counts: dict[str, list[int]] = {c: [0] for c in set(names) if c != d}
        for name in names:
            for c, x in counts.items():
                if name == d:
                    x.append(0)
                elif name == c:
                    x[-1] += 1
        inner |= {c for c, x in counts.items() if x[0] and len(x) > 2 and len(set(x)) == 1}
    out: dict[str, list[float]] = {}
    able = [name for name, _, _, tight in found if name not in inner and not (loose and tight)]
    kinds_of_mark = len(set(able))
    usable = len(able) * (kinds_of_mark + 1) / max(1, 2 * kinds_of_mark)  # of several that share a row, none can have all its cuts
    for k, (name, _, _, tight) in enumerate(found):
        if len(name) > MARK:
            continue
        x = out.setdefault(name, [0.0, usable, 0.0])
        if name in inner or (loose and tight):
            x[1] += 1
        else:
            x[0] += 1
            x[2] += kinds[k] == kinds[k + 1]
    for a, p in zip(ends, pieces):
        between, at_end = inner_words(text[a : a + len(p)])
        for w in between:
            x = out.setdefault(f" {w} ", [0.0, float(len(able)), 0.0])
            x[0] += 1
            x[1] += 1
            x[2] += 1
        for w in at_end:
            x = out.setdefault(f" {w} ", [0.0, float(len(able)), 0.0])
            x[1] += 3
    return {c: (x[0], x[1], x[2]) for c, x in out.items()}


def infer_delimiters(rows: DataFrame) -> DataFrame:
    """(source, delimiters array<string>, n_rows) of each source of rows (source, answer, ...): marks by name, words between spaces.
    Every row counts; the sums are combined before the shuffle, so a source may have any share of the rows. A source without a
    mark has no delimiters; a null source is one of its own ('')."""
    ship_code(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums: dict[tuple[str, str], list[float]] = {}
            for source, answer in zip(f["source"], f["answer"]):
                sums.setdefault((source, ""), [0.0, 0.0, 0.0, 0])[3] += 1
                for c, x in score_row(_lines(answer)).items() if answer is not None else ():
                    t = sums.setdefault((source, c), [0.0, 0.0, 0.0, 0])
                    for k in range(3):
                        t[k] += x[k]
                    t[3] += 1
            yield pd.DataFrame([(s, c, *t) for (s, c), t in sums.items()], columns=["source", "candidate", "cuts", "held", "alike", "n"])

    scored = rows.select(F.coalesce("source", F.lit("")).alias("source"), "answer").mapInPandas(run, "source string, candidate string, cuts double, held double, alike double, n long")
    sums = durable(scored.groupBy("source", "candidate").agg(*(F.sum(c).alias(c) for c in ("cuts", "held", "alike", "n"))))
    of_all = sums.groupBy("candidate").agg(*(F.sum(c).alias("all_" + c) for c in ("cuts", "held", "alike")))
    x = sums.where("candidate <> ''").join(of_all, "candidate")
    fill = lambda a, b: (F.col(a) + SHRINK * F.coalesce(F.try_divide(F.col("all_" + a), F.col("all_" + b)), F.lit(0.0))) / (F.col(b) + SHRINK)
    good = x.where(fill("cuts", "held") * fill("alike", "cuts") >= F.when(F.col("candidate").rlike("^ .* $"), ACCEPT_WORD).otherwise(ACCEPT))
    chosen = good.groupBy("source").agg(F.sort_array(F.collect_list("candidate")).alias("delimiters"))
    return sums.where("candidate = ''").select("source", F.col("n").alias("n_rows")).join(chosen, "source", "left").select("source", F.coalesce("delimiters", F.array().cast("array<string>")).alias("delimiters"), "n_rows")


def _lines(answer: str) -> str:
    return answer.replace("\r\n", "\n").replace("\r", "\n")


def cuts(s: str, delimiters: set[str]) -> list[str]:
    """The pieces of s between the delimiters that aren't protected. A mark with a space before it parts where the mark alone does."""
    text, last, pieces = masked(s), 0, []
    for name, a, b, _ in marks(text, edges=True):
        if name in delimiters or name.lstrip(" ") in delimiters or (" " + name in delimiters and (a == 0 or b == len(text))):
            pieces.append(s[last:a])
            last = b
    pieces.append(s[last:])
    single = "".join(d.strip(" ") for d in delimiters if len(d.strip(" ")) == 1 and not d.strip(" ").isalnum())
    pieces = [p.strip(single + " ") for p in pieces]  # marks beside another one, as in `;` before a line break
    words = [d for d in delimiters if len(d) > 2 and d[0] == d[-1] == " "]
    if not words:
        return pieces
    parted = regex.compile(r"(?<=\S)\s+(?:" + "|".join(regex.escape(w.strip()) for w in words) + r")\s+(?=\S)", regex.I)
    out = []
    for p in pieces:
        text, last = masked(p), 0
        for m in parted.finditer(text):
            out.append(p[last : m.start()])
            last = m.end()
        out.append(p[last:])
    return out


def split_values(rows: DataFrame, delimiters: DataFrame | None = None) -> DataFrame:
    """(field_name, row_key, turn, pos, item): one row per value of each answer of rows (source, field_name, row_key, turn,
    answer), pos from 1.

    The delimiters of each source are inferred from rows unless given. item is the value as written, trimmed, without enclosing
    quotes (inner doubled ones made single), numbering, bullet, joining word or closing full stop; brackets stay. A separator in
    quotes or brackets, and a comma between two digits, part nothing. Empty pieces are no values and take no position; a null or
    blank answer has none; equal values and repeated rows each count; a lone value is one row."""
    ship_code(rows.sparkSession)
    rows = rows.select(F.coalesce("source", F.lit("")).alias("source"), "field_name", "row_key", "turn", "answer").where("answer is not null")
    known = durable(infer_delimiters(rows) if delimiters is None else delimiters)
    total = known.agg(F.sum("n_rows")).first()[0] or 0
    joined = hot_split_join(rows, known, ["source"], "n_rows", total)  # a source may have a third of the rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for field, key, turn, answer, found in zip(f["field_name"], f["row_key"], f["turn"], f["answer"], f["delimiters"]):
                pos = 0
                for piece in cuts(_lines(answer), set(found)):
                    if item := clean(piece):
                        pos += 1
                        out.append((field, key, turn, pos, item))
            yield pd.DataFrame(out, columns=["field_name", "row_key", "turn", "pos", "item"])

    return joined.select("field_name", "row_key", "turn", "answer", "delimiters").mapInPandas(run, "field_name string, row_key long, turn int, pos int, item string")


def turns(conversations: Column) -> Column:
    """The turns that aren't the system's, each with its index from 0 in the whole conversation."""
    numbered = F.transform(F.coalesce(conversations, F.array().cast("array<struct<speaker:string,value:string>>")), lambda t, i: F.struct(i.cast("int").alias("turn"), t["speaker"].alias("speaker"), t["value"].alias("value")))
    return F.filter(numbered, lambda t: F.coalesce(F.lower(F.trim(t["speaker"])), F.lit("")) != "system")


def list_answers(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(source, field_name, row_key, turn, answer) of each list answer: the last second turn of a sample, and a prediction's text.
    The source is the sample's dataset; a prediction's is the first letter of its id."""
    seconds = F.filter(turns(F.col("conversations")), lambda t, i: i % 2 == 1)
    last = samples.where("answer_form = 'list'").select("dataset", "row_no", F.try_element_at(seconds, F.lit(-1)).alias("a"))
    of_samples = last.where("a is not null").select(F.col("dataset").alias("source"), F.lit("conversations").alias("field_name"), F.col("row_no").alias("row_key"), F.col("a.turn").alias("turn"), F.col("a.value").alias("answer"))
    of_predictions = predictions.where("answer_form = 'list'").select(F.lower(F.substring("id", 1, 1)).alias("source"), F.lit("text").alias("field_name"), F.col("pred_no").alias("row_key"), F.lit(0).alias("turn"), F.col("text").alias("answer"))
    return of_samples.unionByName(of_predictions)
