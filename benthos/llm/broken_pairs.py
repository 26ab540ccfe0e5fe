"""Problem 4: defective pairs of question and answer, by tagging the answer's clauses with a conditional random field.

Each clause is an answer, a refusal, an echo of the question, in a foreign language (not the one that the question is in or asks
for) or unfinished. The field is fitted on all the data's own pairs that show no sign of a defect, as they are and with defects made
in them (broken off, replaced by their question, by a refusal, by clauses of another language): tasks fit one each on their share,
and the mean of these, weighted by their pairs, is the field. What a clause is told by is counted over all pairs: character trigrams of each of its languages, so that a
clause that reads unlike the question's language is foreign whether or not its own language is known; the words of sound
answers, which a refusal lacks; the words of refusals, and clauses that recur with unrelated questions. Words, scripts and endings
of known kinds are features beside these. The share of an answer's characters that each tag covers decides its defect."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.llm.clause_sheets import Sheets, triples_in, uniques, usual_of, words_of
from benthos.llm.crf import Crf, Sequences, ranges
from benthos.operators.packed_values import turns
from benthos.session import ship_code, spread, written

#: Sound pairs that one task fits a field on; the fields of all tasks are averaged.
PART = 20_000
#: Sound pairs whose made defects a task holds at once, and visits of pairs up to which a small table is gone through again.
CHUNK, VISITS, EPOCHS = 3000, 18_000, 6
HASHED = 1 << 14
KEPT_CLAUSES = 100_000

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)

#: Stand-ins for nothing, in lower case, after white space and invisible characters are taken off.
STAND_INS = {"", "n/a", "na", "n.a.", "null", "nan", "none", "nil", "-", "--", "---", "–", "—", "_", ".", "..", "...", "…", '""', "''", "“”", "[]", "{}", "()", "?", "<br>", "<br/>", "<br />", "<null>", "<none>", "<empty>", "(empty)", "(none)", "(null)", "[empty]", "[none]", "undefined", "#n/a", "tbd", "empty", "no answer", "&nbsp;", "\\n", "*", "/", "x"}
_INVISIBLE = re.compile(r"[\s​-‏⁠﻿­]+")

#: Common function words that tell a language.
FUNCTION_WORDS = {
    "en": "the of and to is was were are it its with for from at by as that this which what how many why where an be been not near while after before between within over under there their has have had but or he she they we you his her so because than then each every",
    "de": "der die das und ist war im bei von vom zum zur mit ein eine einen einem eines nicht auf für aus nach wurden wurde dem den des sich als auch wie was wo sind über unter neben vor nahe etwa obwohl dass ich kann",
    "es": "el los las del una uno que y con por para se su al es era fue como más pero cerca desde hacia antes después junto aunque donde cuántos qué dónde había sobre lo tenía está no puedo",
    "fr": "le les des une est et dans du au aux sur pour par que qui ne pas plus avec ce cette à été était près vers avant après où on je vous malgré autour sous contre l d",
}
_SHARED = {"de": ("es", "fr"), "la": ("es", "fr"), "en": ("es", "fr"), "un": ("es", "fr"), "in": ("en", "de")}
LANGUAGES = ("en", "de", "es", "fr", "ru", "zh")
_BIT = {x: i for i, x in enumerate(LANGUAGES)}
_VOTES: dict[str, list[int]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_BIT[_lang])
_VOTES |= {w: [_BIT[x] for x in langs] for w, langs in _SHARED.items()}
_ASKED = re.compile(r"\b(?:in|use|using|auf|en|на|用)\s+(english|german|spanish|french|russian|chinese|deutsch|englisch|español|inglés|français|anglais|русском|английском|中文|英文)\b", re.I)
_ASKED_AS = {"english": "en", "englisch": "en", "inglés": "en", "anglais": "en", "английском": "en", "英文": "en", "german": "de", "deutsch": "de", "spanish": "es", "español": "es", "french": "fr", "français": "fr", "russian": "ru", "русском": "ru", "chinese": "zh", "中文": "zh"}

_WANTS_BOX = re.compile(r"\b(?:give|output|return|mark|draw|locate|detect|report|list)\b.{0,90}?\b(?:box|boxes|bbox|coordinates|json)\b", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_ENDS = re.compile(r"[.!?。！？\n](?:(?<=[.!?])\s+|(?<=[。！？])|(?<=\n)\n*)")
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|«[^»]*»|\[[^\]]*\]|\{[^}]*\}')
_QUOTES = re.compile(r'["“«\[{]')
_CYRILLIC, _HAN = re.compile(r"[а-яё]", re.I), re.compile(r"[一-鿿]")
_NORM = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_ASCII_NORM = {k: " " for k in range(128) if not chr(k).isalnum()}
_ASCII_LETTERS = {k: " " for k in range(128) if not chr(k).isalpha()}
# feature numbers below the hashed ones
_BIAS, _FIRST, _LAST, _ONLY = range(4)
_SHORT, _NO_WORDS, _LANG_SAME, _LANG_OTHER, _LANG_OTHER_WEAK, _LANG_NONE, _SCRIPT = range(18, 25)
_ECHO_ALL, _ECHO_PART, _ECHO_BEGIN, _OVERLAP_HIGH, _OVERLAP_MID = range(25, 30)
_END_STOP, _END_NONE, _END_DOTS, _END_OPEN, _UNBALANCED, _OOV, _END_NUMBER, _NO_BOX, _BOX, _NAME_LAST, _DIGIT_STOP = range(30, 41)
_NEW, _APART, _OTHER_SCRIPT = (41, 42, 43), 44, 45
_UNLIKE, _LIKE_OTHER = (46, 47, 48, 49), (50, 51)
_ASIDE = (52, 53, 54)
FIXED = 64
#: Mean log odds of a clause's words to be a refusal's from which a sample's answer is not taken for sound.
SURELY = 1.2
#: Signs at the end of a text that its end is mostly told by.
TAIL = 64
#: Letters of a clause from which its trigrams tell.
LETTERS = 10


def language(text: str, words: list[str] | None = None) -> tuple[int, int]:
    """(language, number of signs of it beyond the next one's), or (-1, 0). words: of the text, if they are known."""
    if not text.isascii():
        han, cyrillic = len(_HAN.findall(text)), len(_CYRILLIC.findall(text))
        if han > 1 or cyrillic > 3:
            return (_BIT["zh"], han) if han * 3 >= cyrillic else (_BIT["ru"], cyrillic // 4 + 1)
    votes = [0] * 4
    for w in words_in(text) if words is None else words:
        if w in _VOTES:
            for k in _VOTES[w]:
                votes[k] += 1
    best = max(range(4), key=votes.__getitem__)
    top = votes[best]
    votes[best] = 0
    return (best, top - max(votes)) if top > max(votes) else (-1, 0)


def plain(text: str) -> str:
    return " ".join(text.translate(_ASCII_NORM).split()) if text.isascii() else _NORM.sub(" ", text).strip()


def words_in(text: str) -> list[str]:
    return text.translate(_ASCII_LETTERS).split() if text.isascii() else _WORD.findall(text)


_SCRIPTS = {name: regex.compile(pattern) for name, pattern in (("latin", r"\p{Latin}"), ("cyrillic", r"\p{Cyrillic}"), ("kana", r"[\p{Hiragana}\p{Katakana}]"), ("han", r"\p{Han}"), ("hangul", r"\p{Hangul}"), ("arabic", r"\p{Arabic}"), ("greek", r"\p{Greek}"), ("other", r"\p{L}"))}
_OF_LANGUAGE = {4: "cyrillic", 5: "han"}


def script(text: str) -> tuple[str, int]:
    """The script that most letters of the text are of, and their number; kana tells before Han."""
    if text.isascii():
        return "latin", sum(map(str.isalpha, text))
    counts, left = {}, 0
    for name, p in _SCRIPTS.items():
        counts[name] = len(p.findall(text)) - (left if name == "other" else 0)
        left += counts[name]
    if counts["kana"] > 1 and counts["kana"] * 6 > counts["han"]:
        return "kana", counts["kana"] + counts["han"]
    best = max(counts, key=counts.get)
    return best, counts[best]


class Trigrams:
    """How well a text reads as one of a language: the mean log probability of its characters after the two before, smoothed by
    shorter contexts, and how far below the usual that is."""

    def __init__(self, triples: Counter, usual: float = -2.0, spread: float = 0.0):
        """triples: how often each three signs stand in texts of the language."""
        self.usual, self.spread = usual, max(0.15, spread)
        grams: list[Counter] = [Counter(), Counter(), triples]
        for g, c in triples.items():
            grams[0][g[2]] += c
            grams[1][g[1:]] += c
        total = max(1, grams[0].total())
        one = {g: (c + 0.5) / (total + 50) for g, c in grams[0].items()}
        self.floor = math.log(0.5 / (total + 50))
        firsts, pairs = Counter(), Counter()
        for g, c in grams[1].items():
            firsts[g[0]] += c
        for g, c in grams[2].items():
            pairs[g[:2]] += c
        two = {g: (c + 3 * one.get(g[1], 0.0)) / (firsts[g[0]] + 3) for g, c in grams[1].items()}
        self.three = {g: math.log((c + 3 * two[g[1:]]) / (pairs[g[:2]] + 3)) for g, c in grams[2].items()}
        self.two = {g: math.log(x) for g, x in two.items()}
        self.one = {g: math.log(x) for g, x in one.items()}

    @classmethod
    def of(cls, texts: list[str]) -> Trigrams:
        half = len(texts) // 2
        first = cls(triples_of(texts[:half] or texts))
        held = [x for t in texts[half:] if (x := first.mean(t)) is not None] or [-2.0]
        return cls(triples_of(texts), float(np.mean(held)), float(np.std(held)))

    def mean(self, text: str) -> float | None:
        t = f"  {_letters(text)} "
        if len(t) < LETTERS + 3:
            return None
        three, two, one, floor = self.three, self.two, self.one, self.floor
        return sum(three.get(t[i : i + 3]) or (two.get(t[i + 1 : i + 3]) or (one.get(t[i + 2]) or floor) - 1.5) - 0.7 for i in range(len(t) - 2)) / (len(t) - 2)

    def unlike(self, mean: float, n: int) -> float:
        """Spreads below the usual; the spread of a short text is wider."""
        return (self.usual - mean) / (self.spread * max(1.0, (40 / n) ** 0.5))


def triples_of(texts: Iterable[str]) -> Counter:
    n: Counter = Counter()
    for t in texts:
        t = f"  {_letters(t)} "
        n.update([t[i : i + 3] for i in range(len(t) - 2)])
    return n


def _letters(text: str) -> str:
    return _NORM.sub(" ", _DIGITS.sub("", text.lower())).strip()


class Knowledge:
    """What is learned from all pairs beside the field: trigrams by language, words of sound pairs, words of refusals."""

    def __init__(self, vocabulary: set[str], words: dict[int, set[str]], trigrams: dict[int, Trigrams], common: set[str], refusing: dict[str, float]):
        self.vocabulary, self.words, self.trigrams, self.common, self.refusing = vocabulary, words, trigrams, common, refusing


class Reader:
    """Features of clauses; what depends on the clause or question alone is kept for when it comes again."""

    def __init__(self, known: Knowledge):
        self.known, self.vocabulary = known, known.vocabulary
        self.clauses: dict[str, tuple] = {}
        self.questions: dict[str, tuple] = {}

    def question(self, text: str | None) -> tuple:
        found = self.questions.get(text)
        if found is None:
            bare = (text or "").replace("<image>", " ").strip()
            low = bare.lower()
            asked = any(w in low for w in _ASKED_AS) and _ASKED.search(low)
            lang = _BIT[_ASKED_AS[asked[1].lower()]] if asked else language(_QUOTED.sub(" ", low) if _QUOTES.search(low) else low)[0]
            wants_box = ("box" in low or "coordinates" in low or "json" in low) and bool(_WANTS_BOX.search(low))
            norm = plain(low)
            found = lang, norm, frozenset(norm.split()), wants_box, _OF_LANGUAGE.get(lang, "latin") if lang >= 0 else ("latin" if bare.isascii() else script(bare)[0]) if bare else None
            if len(self.questions) >= KEPT_CLAUSES:
                self.questions.clear()
            self.questions[text] = found
        return found

    def clause(self, text: str) -> tuple:
        """(features of its own, language, margin, words, script and letters, how it reads as each language)"""
        found = self.clauses.get(text)
        if found is None:
            low = text.lower()
            own = [_BIAS]
            written = _WORD.findall(text)
            words = [w.lower() for w in written]
            if not words:
                own.append(_NO_WORDS)
            elif len(words) <= 3:
                own.append(_SHORT)
            told = self.known.refusing
            pieces = words if low.isascii() else pieces_of(low)
            own += [_lex("r", w) for w in dict.fromkeys(pieces) if w in told]
            aside = aside_of(pieces, told, low)
            own += _ASIDE[: (aside > 0) + (aside > 1) + (aside > 2)]
            # words in upper case are likely names, but for the first
            fresh = [w for w in words[:1] + written[1:] if len(w) > 2 and w.islower()]
            if "[" in text or "{" in text:
                own.append(_BOX)
                lang, margin = -1, 0
            else:
                lang, margin = language(low, words)
                if len(words) < 3 and lang < 4:  # too few words to tell a language
                    lang, margin = -1, 0
            boxes = "[" in text or "{" in text
            found = own, lang, margin, words, ("", 0) if boxes else script(text), None if boxes or len(words) < 2 else {}, [] if boxes or len(words) < 3 else fresh
            if len(self.clauses) >= KEPT_CLAUSES:
                self.clauses.clear()
            self.clauses[text] = found
        return found

    def features(self, question: str | None, clauses: list[str]) -> list[list[int]]:
        expected, qnorm, qwords, wants_box, written = self.question(question)
        model, heard = self.known.trigrams.get(expected), self.known.words.get(expected)
        out, n = [], len(clauses)
        for i, text in enumerate(clauses):
            own, lang, margin, words, (letters, n_letters), means, fresh = self.clause(text)
            f = list(own)
            if fresh and heard:
                new = len([w for w in fresh if w not in heard]) / len(fresh)
                f += _NEW[: (new >= 0.2) + (new >= 0.35) + (new >= 0.6)]
            if written and n_letters > 3 and letters != written and (letters != "latin" or len(words) > 3):
                f.append(_OTHER_SCRIPT)
            elif model and means is not None and n_letters >= LETTERS and not (lang == expected and margin > 1):
                f += self.reading(text, expected, n_letters, means)
            if qwords and len(words) > 2 and not any(w in qwords and w not in self.known.common for w in words):
                f.append(_APART)
            if i == 0:
                f.append(_FIRST)
            if lang < 0:
                f.append(_LANG_NONE)
            elif lang == expected or expected < 0:
                f.append(_LANG_SAME)
            elif margin > 1:
                f.append(_LANG_OTHER)
                if lang > 3 or expected > 3:
                    f.append(_SCRIPT)
            else:
                f.append(_LANG_OTHER_WEAK)
            if words and qwords:
                shared = len([w for w in words if w in qwords]) / len(words)
                if shared > 0.8 or (lang == 5 and expected == 5):
                    f.append(_OVERLAP_HIGH)
                    if echoed := echo(text, qnorm):
                        f.append(echoed)
                elif shared > 0.5:
                    f.append(_OVERLAP_MID)
            if i == n - 1:
                f.append(_LAST)
                if n == 1:
                    f.append(_ONLY)
                f += self.ending(text, words, wants_box)
            out.append(f)
        return out

    def reading(self, text: str, expected: int, n: int, known: dict[int, list[int]]) -> list[int]:
        """How unlike the expected language a clause reads, and whether it reads more like another; the others are tried only if it
        is unlike. known: what was found before, by language."""
        if expected not in known:
            low, models = text.lower(), self.known.trigrams
            mean = models[expected].mean(low)
            z = 0.0 if mean is None else models[expected].unlike(mean, n)
            f = list(_UNLIKE[: (z > 1.5) + (z > 2.5) + (z > 4) + (z > 6)])
            if f:
                gain = max((m for k, t in models.items() if k != expected and (m := t.mean(low)) is not None), default=-99.0) - mean
                f += _LIKE_OTHER[: (gain > 0.1) + (gain > 0.6)]
            known[expected] = f
        return known[expected]

    def ending(self, text: str, words: list[str] | bool, wants_box: bool) -> list[int]:
        """How the last clause ends."""
        end = text.rstrip().rstrip("\"'”’»)*_")
        if "{" in text or "[" in text:
            whole = text.count("[") == text.count("]") and text.count("{") == text.count("}") and text.count('"') % 2 == 0
            return [_END_STOP] if whole and re.search(r"[\]})][\s.,]*$", text) and not re.search(r",\s*$", text) else [_UNBALANCED]
        if "(" in text and re.search(r"\([^()]*\)\W*$", text):  # a remark after the end
            return [_END_STOP]
        f = []
        if wants_box and words and not end.endswith(_STOPS):
            f.append(_NO_BOX)
        if end.endswith(("...", "…")):
            return [*f, _END_DOTS]
        if end.endswith(_STOPS):
            return [*f, _DIGIT_STOP if end[-1] == "." and end[-2:-1].isdecimal() else _END_STOP]
        if end.endswith((",", ";", ":", "-", "–", "—", "，", "、", "；", "：", "(", "/")):
            return [*f, _END_OPEN]
        f.append(_END_NONE)
        wide = not text.isascii()
        if wide and _HAN.search(text):
            return [*f, _lex("z", text[-1]), _lex("y", text[-2:]), _lex("x", text[-3:])]
        # the last words tell, unless there are too few or too many names among them
        tokens = _TOKENS if wide else _ASCII_TOKENS
        k = text.find(" ", len(text) - TAIL) if len(text) > TAIL else -1
        if k > 0 and (told := self._last_words(tokens.findall(text, k), True)) is not None:
            return f + told
        return f + self._last_words(tokens.findall(text), False)

    def _last_words(self, tokens: list[str], more: bool) -> list[int] | None:
        """What the last words tell; more: some stand before these, and None if those are needed."""
        if more and len(tokens) < 6:
            return None
        f: list[int] = []
        if not tokens:
            return f
        last, n = tokens[-1], len(tokens)
        if last[0].isdigit():
            f.append(_END_NUMBER)
        elif last[0].isupper() and n > 1:
            f.append(_NAME_LAST)
        elif n > 3 and last.lower() not in self.vocabulary:
            f.append(_OOV)
        if n > 3:
            run, before, k = 0, [], n - 1
            while k >= 0 and len(before) < 4:  # from the end on; names of several words as one
                t = tokens[k]
                shape = "0" if t[0].isdigit() else "N" if k and t[0].isupper() else t.lower()
                if shape == "N":
                    run += run == n - 1 - k
                    if k + 1 == n or above != "N":
                        before.append(shape)
                else:
                    before.append(shape)
                above, k = shape, k - 1
            if more and k < 0:
                return None
            before.reverse()
            low, crc = last.lower(), zlib.crc32
            two, three, four = ("\t".join(before[k:]) for k in (-2, -3, -4))
            f += [FIXED + crc(x.encode()) % (HASHED - FIXED) for x in (f"a\t{low}", f"b\t{two}\t{run}", f"c\t{three}\t{run}", f"d\t{four}\t{run}")]
            if len(before) > 1:
                f.append(FIXED + crc(f"e\t{before[-2]}\t{low}".encode()) % (HASHED - FIXED))
        return f


_TOKENS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[一-鿿]")
_ASCII_TOKENS = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*")
_STOPS = (".", "!", "?", "。", "！", "？")


def echo(text: str, qnorm: str) -> int:
    """How a clause repeats the question, or 0."""
    norm = plain(text.lower())
    bare = _ECHO_LEAD.sub("", norm)
    if qnorm in norm:
        return _ECHO_ALL
    if len(bare) > 3 and qnorm.startswith(bare):
        return _ECHO_BEGIN
    return _ECHO_PART if len(bare) > 7 and bare in qnorm else 0


_ECHO_LEAD = re.compile(r"^(?:q|question|query|prompt|user|human)\s+")


def tongue(clause: str) -> int:
    """The language of a clause, as Reader.clause says."""
    if "[" in clause or "{" in clause:
        return -1
    words = words_in(low := clause.lower())
    lang = language(low, words)[0]
    return -1 if len(words) < 3 and lang < 4 else lang


def _lex(*parts) -> int:
    return FIXED + zlib.crc32("\t".join(map(str, parts)).encode()) % (HASHED - FIXED)


def is_nothing(answer: str | None) -> bool:
    return answer is None or (len(answer) < 40 and _INVISIBLE.sub("" if len(answer) < 8 else " ", answer).strip().lower() in STAND_INS)


def clauses_of(answer: str) -> list[str]:
    return parted(answer, ends_of(answer))


def ends_of(text: str) -> list[tuple[int, int, int]]:
    """Of each end of a clause: the least length of a text broken off here that has it, where the clause ends, and the next begins."""
    return [(k + 1 + (text[k] not in "。！？"), k + (text[k] != "\n"), m.end()) for m in _CLAUSE_ENDS.finditer(text) for k in (m.start(),)]


def parted(text: str, ends: list[tuple[int, int, int]]) -> list[str]:
    parts, at = [], 0
    for _, to, after in ends:
        if c := text[at:to].strip():
            parts.append(c)
        at = after
    if c := text[at:].strip():
        parts.append(c)
    return parts


def decide(clauses: list[str], tags: list[int], qnorm: str, qwords: frozenset[str]) -> str | None:
    """The defect of an answer whose clauses have these tags: by the characters that each tag covers. A copy must also hold the
    whole question, or no more than a tenth of other words."""
    sizes = [len(c) for c in clauses]
    cover = [0.0] * 5
    for n, t in zip(sizes, tags):
        cover[t] += n / sum(sizes)
    if cover[ECHO] > 0.9:
        norm = plain(" ".join(clauses).lower())
        words = norm.split()
        return "copy" if qnorm and (qnorm in norm or sum(w in qwords for w in words) >= 0.9 * len(words)) else None
    if cover[REFUSAL] > 0.4:
        return "refusal"
    if cover[FOREIGN] > 0.5:
        return "language"
    if tags[-1] == UNFINISHED:
        return "truncated"
    return None


# --- fitting ---------------------------------------------------------------------------------------------------------

#: Refusals to learn from, beside those of the sample: how they begin, what they say, how they go on.
_OPENERS = ["", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise, but ", "I apologise, however ", "Apologies, ", "As an AI model, ", "As a language model ", "Regrettably ", "Thank you for asking, but ", "I'm afraid ", "With respect, ", "At the moment "]
_CORES = [
    "I can't help with that", "I cannot answer this question", "I am unable to do so", "I am unable to comply", "I am not able to see any picture", "I cannot view or analyse images", "I won't be able to respond", "I must decline to answer",
    "I'd rather not say", "I would prefer not to discuss this topic", "I have to pass on this task", "it is not possible for me to assist", "there is no way for me to know", "there is no way for me to tell you that", "answering this goes beyond what I am allowed to do",
    "this is beyond my capabilities", "I do not have access to the image", "this is something I can’t respond to", "I have no comment on that matter", "no answer can be given to a request of this kind", "this request lies outside the scope of what the assistant covers",
    "such topics are not supported by this service", "replying would break the content policy", "providing this information would violate our guidelines", "the rules do not permit a reply here", "I am not comfortable responding to this", "please understand that we cannot comment on this issue",
    "we are not in a position to answer your query", "I don't know and cannot find out", "your question can't be answered by this system", "this falls under restricted content", "I refuse to reply to this prompt",
]
_CLOSERS = ["", "", "", " Please provide more context.", " You may want to ask an expert instead.", " Is there something else I can do for you?", " Try another question."]
_ABROAD = [
    "Lo siento, pero no puedo responder a esa pregunta.", "No me es posible ayudar con esta solicitud.", "Désolé, je ne peux pas vous aider.", "Je ne suis pas en mesure de répondre à cette demande.", "Leider kann ich diese Frage nicht beantworten.", "Es tut mir leid, ich kann dabei nicht helfen.",
    "Ich bin nicht in der Lage, das zu beurteilen.", "Извините, я не могу ответить на этот вопрос.", "К сожалению, я вынужден отказаться от ответа.", "Я не могу помочь с этим запросом.", "抱歉，我无法回答这个问题。", "对不起，我不能提供帮助。", "很遗憾，这个请求我无法处理。",
]


def pieces_of(low: str) -> list[str]:
    """Words of a text in lower case, and pairs of Han characters."""
    if low.isascii():
        return words_in(low)
    words = _WORD.findall(low.replace("’", "'"))
    return [w for w in words if not _HAN.search(w)] + [w[i : i + 2] for w in words if _HAN.search(w) for i in range(len(w) - 1)] if _HAN.search(low) else words


def aside_of(words: list[str], refusing: dict[str, float], low: str) -> float:
    """The mean log odds of the words (or Han pairs) of a text to be a refusal's."""
    if len(words) < 3 and not (words and _HAN.search(low)):
        return -1.0
    known = [refusing[w] for w in words if w in refusing]
    return (sum(known) - len(words) + len(known)) / len(words)


def made_refusal(rng: random.Random) -> str:
    closer = rng.choice(_CLOSERS)
    text = rng.choice(_ABROAD) if rng.random() < 0.3 else rng.choice(_OPENERS) + rng.choice(_CORES) + (rng.choice([".", "!", "…"]) + closer if closer else rng.choice([".", "", "", "!", "…"]))
    return text.upper() if rng.random() < 0.05 else text


#: Sound pairs of kinds that a sample may lack.
_SOUND = [("Is it there?", "yes"), ("Is it there?", "No."), ("How many are there?", "12"), ("Which one is right? a:1 b:2", "B"), ("Which kind is it?", "red snapper"), ("Return the box as JSON.", '{"bbox_2d": [1, 2, 30, 40], "label": "ray"}'), ("Where is it? Output the coordinates.", "ray 1: [0.1,0.2,0.3,0.4]")]
_DECORATE = [lambda q: q, lambda q: "Q: " + q, lambda q: "Question: " + q, lambda q: "> " + q, lambda q: "You asked: " + q, lambda q: "The question was: " + q, lambda q: "Here is your question again: " + q, lambda q: q.upper(), lambda q: q.lower(), lambda q: q.replace(" ", "  "), lambda q: q.rstrip("?. ") + "...", lambda q: f'"{q}"', lambda q: q + " " + q, lambda q: q.rstrip("?.")]


#: How often words stand in the refusals to learn from.
_TOLD = Counter(w for t in [*(c + x for c in _CORES for x in _CLOSERS), *(o + "x" for o in _OPENERS), *_ABROAD * 4] for w in pieces_of(t.lower()))
_PLAIN_WORDS = {"the", "a", "this", "that", "is", "in", "of"}


def said_in(pairs: list[tuple[str | None, str | None]]) -> Counter:
    """In how many clauses each word of refusals stands, and under "" how many words all clauses have."""
    return Sheets(prober(dict.fromkeys(_TOLD, 0.0))).said([c for _, a in pairs if a for c in clauses_of(a)])


def odds_of(said: Counter) -> dict[str, float]:
    """The log odds of words to be a refusal's rather than an answer's."""
    n_told, n_said = _TOLD.total(), max(1, said[""])
    return {w: math.log((c + 0.5) / n_told) - math.log((said[w] + 0.5) / n_said) for w, c in _TOLD.items()}


def refusing_in(pairs: list[tuple[str | None, str | None]], odds: dict[str, float]) -> list[tuple[str, str]]:
    """(clause, question) of clauses that read like a refusal and repeat nothing of their question."""
    return looked_at(pairs, Sheets(prober(odds)))[1]


def refusal_words(pairs: list[tuple[str | None, str | None]]) -> tuple[dict[str, float], list[str]]:
    """The log odds of words to be a refusal's, and the pairs' own refusals: clauses that read like one and recur with different
    questions."""
    odds, asked = odds_of(said_in(pairs)), {}
    for c, q in refusing_in(pairs, odds):
        asked.setdefault(c, set()).add(q)
    return odds, [c for c, qs in asked.items() if len(qs) > 1]


#: A sound pair: question, clauses, language that is expected, language of each clause, whether it is of sentences without boxes.
Sound = tuple[str, list[str], int, list[int], bool]


def sound_in(pairs: list[tuple[str | None, str | None]], probe: Reader) -> list[tuple[int, Sound]]:
    """The pairs that show no sign of a defect, with their place. probe: a reader that knows the words of refusals."""
    return looked_at(pairs, Sheets(probe))[0]


def looked_at(pairs: list[tuple[str | None, str | None]], sheets: Sheets) -> tuple[list[tuple[int, Sound]], list[tuple[str, str]]]:
    """What sound_in and refusing_in say; sheets: of a reader that knows the words of refusals."""
    probe, numbers = sheets.reader, {}
    answers = [clauses_of(a) if q and a else [] for q, a in pairs]
    places = [[numbers.setdefault(c, len(numbers)) for c in parts] for parts in answers]
    of = sheets.clauses(list(numbers)) if numbers else {"aside": np.zeros(0), "lang": np.zeros(0), "margin": np.zeros(0)}
    asides, langs, margins = of["aside"].tolist(), of["lang"].tolist(), of["margin"].tolist()
    sound, refusing = [], []
    for at, ((q, a), parts, own) in enumerate(zip(pairs, answers, places)):
        for c, k in zip(parts, own):
            if asides[k] > 0:
                cut = c.lower().rstrip(".!…。")
                words = pieces_of(cut)
                if len(words) > 3 and not set(words) & (set(pieces_of(q.lower())) - _PLAIN_WORDS):
                    refusing.append((cut, q))
        if not parts or is_nothing(a) or any(asides[k] > SURELY for k in own):
            continue
        expected, qnorm, _, _, _ = probe.question(q)
        if expected >= 0 and any(langs[k] >= 0 and langs[k] != expected and margins[k] > 1 for k in own):
            continue
        last = parts[-1]
        sentence = bool(len(last.split()) > 4 or not a.isascii() and _HAN.search(a))
        boxes = "[" in a
        whole = _WHOLE.search(a.strip()) if sentence and not boxes else not ("[" in last or "{" in last) or probe.ending(last, True, False) != [_UNBALANCED]
        if not whole or (qnorm and qnorm.split(" ", 1)[0] in (low := a.lower()) and qnorm in plain(low) and len(plain(a)) < 1.3 * len(qnorm) + 12):
            continue
        sound.append((at, (q, parts, expected, [langs[k] for k in own], sentence and not boxes)))
    return sound, refusing


_WHOLE = re.compile(r"[.!?。！？][\"'”’]*$")


def spoken_in(pair: Sound) -> list[str]:
    """The texts of a sound pair that are in the language of its question."""
    q, parts, expected, langs, told = pair
    return [q.replace("<image>", " "), *(c for c, k in zip(parts, langs) if told and k in (expected, -1))] if expected >= 0 else []


def counted(sound: list[Sound]) -> Counter:
    """By (kind, language, word), how often words stand in sound pairs: `word` in clauses with their apostrophes, `heard` by
    language in pairs, `every` in pairs at all."""
    clauses, asked = [c for x in sound for c in x[1]], [x[0].replace("\n", " ") for x in sound]
    lines = "\n".join([*clauses, *asked])
    if "İ" in lines:  # its lower case is two signs, which part a word
        return counted_one_by_one(sound)
    tokens, sizes = words_of(lines.lower().split("\n"), _LINKS) if sound else ([], np.zeros(0, np.int64))
    names = {w: k for k, w in enumerate(dict.fromkeys(["\n", *tokens]))}
    numbers = np.fromiter(map(names.__getitem__, tokens), np.int64, len(tokens))
    text, texts = np.repeat(np.arange(len(sizes)), sizes), len(clauses) + len(asked)
    many = np.zeros(texts, np.int64)
    many[: len(clauses)] = np.repeat(np.arange(len(sound)), [len(x[1]) for x in sound])
    many[len(clauses) :] = np.arange(len(sound))
    own = text < len(clauses)
    hyphened = np.bincount(distinct(text[own], numbers[own]), minlength=len(names)).tolist()
    n: Counter = Counter({("word", -1, w): hyphened[k] for w, k in names.items() if k and hyphened[k]})
    # the words of tokens, most of which are one
    words: dict[str, int] = {}
    pieces = [[words.setdefault(w, len(words)) for w in ([t] if t.isalpha() else _WORD.findall(t))] for t in names]
    sizes = np.array([len(x) for x in pieces])
    flat, times = np.array([k for x in pieces for k in x], np.int64), sizes[numbers]
    word = flat[ranges((np.cumsum(sizes) - sizes)[numbers], times)]
    pair, own = np.repeat(many[text], times), np.repeat(own, times)
    expected = np.array([x[2] for x in sound], np.int64)
    every = np.bincount(distinct(pair[own], word[own]), minlength=len(words)).tolist()
    n.update({("every", -1, w): every[k] for w, k in words.items() if every[k]})
    for k in {x[2] for x in sound if x[2] >= 0}:
        mine = (expected == k)[pair]
        heard = np.bincount(distinct(pair[mine], word[mine]), minlength=len(words)).tolist()
        n.update({("heard", k, w): heard[j] for w, j in words.items() if heard[j]})
    return n


_HYPHENED = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LINKS = tuple(map(ord, "'’-"))


def distinct(groups: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The numbers, each once in its group."""
    return uniques((groups << 32) | numbers) & 0xFFFFFFFF


def counted_one_by_one(sound: list[Sound]) -> Counter:
    n: Counter = Counter()
    for q, parts, expected, _, _ in sound:
        for c in parts:
            n.update({("word", -1, w.lower()) for w in _HYPHENED.findall(c)})
        of_parts = {w for c in parts for w in _WORD.findall(c.lower())}
        n.update(("every", -1, w) for w in of_parts)
        if expected >= 0:
            n.update(("heard", expected, w) for w in of_parts.union(_WORD.findall(q.lower())))
    return n


def knowledge(n: Counter, n_sound: int, trigrams: dict[int, Trigrams], odds: dict[str, float]) -> Knowledge:
    """What is known by the counts of all sound pairs."""
    vocabulary, words, common = set(), {}, set()
    for (kind, lang, w), c in n.items():
        # what two sound records have is no surprise in a third
        if kind == "every":
            if c > n_sound / 40:
                common.add(w)
        elif c > 1 or n_sound < 200:
            (vocabulary if kind == "word" else words.setdefault(lang, set())).add(w)
    return Knowledge(vocabulary, words, trigrams, common, odds)


def prober(odds: dict[str, float]) -> Reader:
    return Reader(Knowledge(set(), {}, {}, set(), odds))


def training_set(pairs: list[tuple[str | None, str | None]], seed: int = 3) -> tuple[Reader, list, list]:
    """The reader with what it knows of these pairs, and sequences of features with their tags: sound pairs, and made defects."""
    rng = random.Random(seed)
    odds, recurring = refusal_words(pairs)
    sound = [x for _, x in sound_in([*pairs, *_SOUND * max(2, len(pairs) // 100)], prober(odds))]
    spoken: dict[int, list[str]] = {}
    for x in sound:
        spoken.setdefault(x[2], []).extend(spoken_in(x))
    rng.shuffle(sound)
    trigrams = {k: Trigrams.of(rng.sample(t, len(t))) for k, t in spoken.items() if len(t) > 20}
    reader = Reader(knowledge(counted(sound), len(sound), trigrams, odds))
    seq = made(sound, reader, recurring, languages_of(sound), rng)
    return reader, *seq.lists()


def languages_of(sound: list[Sound]) -> dict[int, list[list[str]]]:
    """The answers in sentences of each language."""
    found: dict[int, list[list[str]]] = {}
    for _, parts, _, langs, told in sound:
        if told:
            found.setdefault(langs[0], []).append(parts)
    return found


def made(sound: list[Sound], reader: Reader, recurring: list[str], by_language: dict[int, list[list[str]]], rng: random.Random, n_sound: int | None = None, sheets: Sheets | None = None) -> Sequences:
    """Sequences of features and their tags of sound pairs and of defects made in each; n_sound: of the pairs that by_language is of,
    if they are more."""
    n_sound = n_sound or len(sound)
    answers, gold, without = [], [], []

    def add(q: str, parts: list[str], tags: list[int], left_out: int = 0) -> None:
        """left_out: 1 or 2 for features left out as of words of refusals or of a language that the sample doesn't have."""
        if parts:
            answers.append((q, parts))
            gold.extend(tags)
            without.append(left_out)

    known = [k for k in by_language if k >= 0 and len(by_language[k]) > 4]
    weight = {k: min(12, max(1, n_sound // (6 * len(v)))) for k, v in by_language.items()}  # few rows of a language count more
    for q, parts, expected, langs, _ in sound:
        bare = q.replace("<image>", "").strip()
        add(q, parts, [ANSWER] * len(parts))
        if rng.random() < 0.2:  # a null or empty question
            add("", parts, [ANSWER] * len(parts))
        lang = langs[0]
        sentence = len(parts[-1].split()) > 4 or bool(_HAN.search(parts[-1]))
        boxes = "[" in parts[-1]
        text = "\n".join(parts) if boxes else " ".join(parts)
        ends = ends_of(text) if sentence or boxes else []
        undotted = [*parts[:-1], re.sub(r"[.。]$", "", parts[-1])] if sentence and not boxes else parts
        for _ in range(weight.get(lang, 1) if sentence and not boxes else 1):
            if sentence and not boxes:
                for _ in range(1 + (rng.random() < 0.5)):
                    add(q, undotted, [ANSWER] * len(parts))
            if sentence or boxes:
                for _ in range(3):
                    cut = text[: rng.randint(max(4, len(text) // 5), max(5, len(text) - 3))].rstrip()
                    if boxes and re.search(r"[\]}]$", cut):
                        continue
                    broken = parted(cut + rng.choice(["", "", "", "", "…", "...", ","]), [x for x in ends if x[0] <= len(cut)])
                    if broken and not (broken[-1].endswith(_STOPS) and not broken[-1].endswith("..")):
                        add(q, broken, [ANSWER] * (len(broken) - 1) + [UNFINISHED])
        if bare and rng.random() < 0.35:
            again = clauses_of(rng.choice(_DECORATE)(bare))
            add(q, again, [ECHO] * len(again))
            if sentence and not boxes and rng.random() < 0.4:
                first = clauses_of(bare)
                add(q, first + parts, [ECHO] * len(first) + [ANSWER] * len(parts))
        if rng.random() < 0.4:
            no = clauses_of(rng.choice(recurring) if recurring and rng.random() < 0.15 else made_refusal(rng))
            known_tongue = all(tongue(c) in (-1, expected) for c in no)  # else nothing but its words tells it from an answer abroad
            add(q, no, [REFUSAL] * len(no), 1 if known_tongue and rng.random() < 0.25 else 0)
        others = [k for k in known if k not in (lang, expected)]
        if others and rng.random() < 0.35:
            there = rng.choice(by_language[rng.choice(others)])
            there = [*there[:-1], re.sub(r"[.。]$", "", there[-1])] if rng.random() < 0.2 else there
            add(q, there, [FOREIGN] * len(there), 2 if rng.random() < 0.4 else 0)
    items, features, sizes = (sheets or Sheets(reader)).read(answers)
    drop = np.zeros((3, HASHED), bool)
    drop[1, [*(_lex("r", w) for w in reader.known.refusing), *_ASIDE]] = True
    drop[2, [_LANG_OTHER, _LANG_OTHER_WEAK, _SCRIPT, *_LIKE_OTHER]] = True
    left_out = np.repeat(np.array(without, np.int64), sizes)
    keep = ~drop[left_out[items], features]
    items, features = items[keep], features[keep]
    bare_of = left_out == 2
    bare_of[items[features == _LANG_NONE]] = False
    more = np.flatnonzero(bare_of)
    return Sequences.of(np.concatenate([items, more]), np.concatenate([features, np.full(len(more), _LANG_NONE)]), sizes, np.array(gold, np.int64))


def fit(pairs: list[tuple[str | None, str | None]]) -> tuple[Crf, Knowledge]:
    reader, xs, ys = training_set(pairs)
    model = Crf(HASHED, 5)
    if xs:
        model.fit(xs, ys, epochs=EPOCHS)
    return model, reader.known


def fit_part(sound: list[Sound], known: Knowledge, recurring: list[str], seed: int = 3) -> Crf:
    """The field of a task's sound pairs, all of which are gone through in chunks; several times if they are few."""
    rng, model, sheets = random.Random(seed), Crf(HASHED, 5), Sheets.of(known, Reader)
    reader = sheets.reader
    rng.shuffle(sound)
    by_language = languages_of(sound)
    epochs = max(1, min(EPOCHS, VISITS // max(1, len(sound))))
    size = CHUNK if epochs == 1 else len(sound)
    for at in range(0, len(sound), size):
        model.fit_on(made(sound[at : at + size], reader, recurring, by_language, rng, len(sound), sheets), epochs=epochs)
    return model


def pairs_of(f: pd.DataFrame) -> list[tuple[str | None, str | None]]:
    return list(zip(f["question"].tolist(), f["answer"].tolist()))


def sound_rows(f: pd.DataFrame) -> list[Sound]:
    return [(q, p.split("\n"), e, [int(x) - 1 for x in k], t) for q, p, e, k, t in zip(f["question"].tolist(), f["parts"].tolist(), f["expected"].tolist(), f["langs"].tolist(), f["told"].tolist())]


def sound_table(spark: SparkSession, pairs: DataFrame, odds: dict[str, float]) -> DataFrame:
    """The sound pairs as a table, and those of kinds that the data may lack, a hundredth as many each (clauses are parted by line
    ends, a digit stands for the language of each); beside them the clauses that read like a refusal (kind `refusing`, the clause in
    parts), and by kind, language (in expected) and word, how often words and triples stand in the sound pairs of a task."""
    columns = ["kind", "row_key", "turn", "question", "parts", "expected", "langs", "told", "half", "word", "n"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sheets, total = Sheets(prober(odds)), Counter()
        for f in frames:
            sound, refusing = looked_at(pairs_of(f), sheets)
            read = [x for _, x in sound]
            keys, turn = f["row_key"].tolist(), f["turn"].tolist()
            yield pd.DataFrame(
                {
                    "kind": "sound",
                    "row_key": [keys[at] for at, _ in sound],
                    "turn": [turn[at] for at, _ in sound],
                    "question": [x[0] for x in read],
                    "parts": ["\n".join(x[1]) for x in read],
                    "expected": [x[2] for x in read],
                    "langs": ["".join([str(k + 1) for k in x[3]]) for x in read],
                    "told": [x[4] for x in read],
                    "half": [_half(x) for x in read],
                    "word": "",
                    "n": 0,
                },
                columns=columns,
            )
            if refusing:
                yield pd.DataFrame([("refusing", 0, 0, q, c, -1, "", False, 0, "", 0) for c, q in refusing], columns=columns)
            total.update(tally(read))
        yield pd.DataFrame([(kind, 0, 0, "", "", lang, "", False, 0, w, n) for (kind, lang, w), n in total.items()], columns=columns)

    few = spark.createDataFrame([(k, q, a) for k, (q, a) in enumerate(_SOUND)], "turn int, question string, answer string")
    lent = spark.range(max(2, pairs.count() // 100)).select((-1 - F.col("id")).alias("row_key")).crossJoin(F.broadcast(few))
    every = spread(pairs.unionByName(lent))
    return written(every.mapInPandas(run, "kind string, row_key long, turn int, question string, parts string, expected int, langs string, told boolean, half int, word string, n long"), "sound")


def _half(x: Sound) -> int:
    return zlib.crc32(f"{x[0]} {x[1][0]}".encode()) & 1


def tally(sound: list[Sound]) -> Counter:
    """By (kind, language, word), what is counted of sound pairs: what counted() says, texts, and the triples of either half."""
    n, texts = counted(sound), {}
    for x in sound:
        if spoken := spoken_in(x):
            n["texts", x[2], ""] += len(spoken)
            texts.setdefault((f"half{_half(x)}", x[2]), []).extend(spoken)
    return n + Counter({(*k, g): c for k, t in texts.items() for g, c in triples_in(t).items()})


def learned(table: DataFrame, n_sound: int, odds: dict[str, float]) -> Knowledge:
    """What is known by the counts over all sound pairs. How a language usually reads is told by the half of its texts that the
    counts for it leave out."""
    sound = table.where("kind = 'sound'")
    # of words, those that knowledge() takes
    kept = F.when(F.col("kind") == "every", F.col("n") > n_sound / 40).when(F.col("kind").isin("word", "heard"), (F.col("n") > 1) | F.lit(n_sound < 200)).otherwise(True)
    sums = table.where("kind not in ('sound', 'refusing')").groupBy("kind", F.col("expected").alias("lang"), "word").agg(F.sum("n").alias("n"))
    words, halves, texts = Counter(), {}, Counter()
    for kind, lang, word, n in sums.where(kept).collect():
        if kind.startswith("half"):
            halves.setdefault(lang, (Counter(), Counter()))[int(kind[4])][word] = n
        elif kind == "texts":
            texts[lang] = n
        else:
            words[kind, lang, word] = n
    firsts = {k: Trigrams(a or b) for k, (a, b) in halves.items() if texts[k] > 20}

    def usual(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {k: usual_of(t) for k, t in firsts.items()}
        for f in frames:
            texts: dict[int, list[str]] = {}
            for x in sound_rows(f):
                if x[2] in firsts:
                    texts.setdefault(x[2], []).extend(spoken_in(x))
            yield pd.DataFrame([(k, *tables[k](t)) for k, t in texts.items()], columns=["lang", "n", "sum", "square"])

    read = sound.where("half = 1 and expected >= 0").select("question", "parts", "expected", "langs", "told").mapInPandas(usual, "lang int, n double, sum double, square double")
    usuals = {r["lang"]: r for r in read.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("n", "sum", "square"))).collect()}
    trigrams = {}
    for k in sorted(firsts):
        n = usuals[k]["n"] if k in usuals else 0.0
        mean = usuals[k]["sum"] / n if n else -2.0
        trigrams[k] = Trigrams(halves[k][0] + halves[k][1], mean, math.sqrt(max(0.0, usuals[k]["square"] / n - mean * mean)) if n else 0.0)
    return knowledge(words, n_sound, trigrams, odds)


def fit_all(samples: DataFrame) -> tuple[Crf, Knowledge]:
    """The field and what is known, of all pairs of samples but lists. Gathered are only words and triples with their counts, the
    refusals that recur, and one weight for each feature and label."""
    spark = samples.sparkSession
    ship_code(spark)
    pairs = spread(record_pairs(samples))

    def said(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for f in frames:
            n.update(said_in([(None, a) for a in f["answer"].tolist()]))
        yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    odds = odds_of(Counter({w: n for w, n in pairs.select("answer").mapInPandas(said, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}))
    table = sound_table(spark, pairs, odds)
    refusing = table.where("kind = 'refusing'").groupBy(F.col("parts").alias("c")).agg(F.min("question").alias("a"), F.max("question").alias("b")).where("a <> b")
    recurring = sorted(r["c"] for r in refusing.select("c").collect())
    sound = table.where("kind = 'sound'")
    n_sound = sound.count()
    known = learned(table, n_sound, odds)
    shared = spark.sparkContext.broadcast((known, recurring))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for f in frames for x in sound_rows(f)]
        if rows:
            model = fit_part(rows, *shared.value)
            w = np.concatenate([model.w.ravel(), model.t.ravel()]) * len(rows)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], float(len(rows)))})

    dealt = sound.drop("kind", "half", "word", "n").repartition(max(1, -(-n_sound // PART)), "row_key", "turn").sortWithinPartitions("row_key", "turn", "question")
    sums = dealt.mapInPandas(run, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas()
    model, total = Crf(HASHED, 5), np.zeros(HASHED * 5 + 25)
    ends = sums["at"].to_numpy() >= 0
    total[sums["at"].to_numpy()[ends]] = sums["w"].to_numpy()[ends] / sums["w"].to_numpy()[~ends].sum()
    model.w, model.t = total[:-25].reshape(HASHED, 5).copy(), total[-25:].reshape(5, 5).copy()
    return model, known


# --- applying --------------------------------------------------------------------------------------------------------


def answers(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(field_name, row_key, turn, question, answer) of every answer that isn't a list: each second turn of a conversation, and a
    prediction's text and gt. A list row's earlier rounds are answers too."""
    t = turns(F.col("conversations"))
    numbered = samples.select("row_no", "answer_form", t.alias("t"))
    pair = F.transform(
        F.sequence(F.lit(1), F.size("t") - 1, F.lit(2)),
        lambda i: F.struct(F.get("t", i)["turn"].alias("turn"), F.get("t", i - 1)["value"].alias("question"), F.get("t", i)["value"].alias("answer"), (i + 2 > F.size("t") - 1).alias("last")),
    )
    rounds = numbered.where("size(t) > 1").select(F.col("row_no").alias("row_key"), "answer_form", F.inline(pair))
    of_samples = rounds.where(~(F.coalesce(F.col("answer_form") == "list", F.lit(False)) & F.col("last"))).select(F.lit("conversations").alias("field_name"), "row_key", "turn", "question", "answer")
    fields = F.inline(F.array(F.struct(F.lit("text").alias("field_name"), F.col("text").alias("answer")), F.struct(F.lit("gt").alias("field_name"), F.col("gt").alias("answer"))))
    of_predictions = predictions.where("answer_form is null or answer_form <> 'list'").select(F.col("pred_no").alias("row_key"), F.col("prompt").alias("question"), fields).select("field_name", "row_key", F.lit(0).alias("turn"), "question", "answer")
    return of_samples.unionByName(of_predictions)


def record_pairs(samples: DataFrame) -> DataFrame:
    """(row_key, turn, question, answer) of the records that are no lists."""
    told = samples.where("row_no is not null and (answer_form is null or answer_form <> 'list')")
    none = told.select(F.lit(None).cast("long").alias("pred_no"), *(F.lit(None).cast("string").alias(c) for c in ("prompt", "text", "gt", "answer_form"))).limit(0)
    return answers(told, none).select("row_key", "turn", "question", "answer")


def sample_pairs(samples: DataFrame, rows: int) -> list[tuple[str | None, str | None]]:
    """The pairs of the `rows` records with the least hashes, gathered to look at; `defects` is fitted on all records instead."""
    few = samples.where("row_no is not null and (answer_form is null or answer_form <> 'list')").orderBy(F.xxhash64("row_no"), "row_no").limit(rows)
    return pairs_of(record_pairs(few).orderBy("row_key", "turn").toPandas())


def defects(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(field_name, row_key, turn, defect) of each defective answer: empty, truncated, refusal, copy or language; one at most.

    A null or blank answer, or one that is only a stand-in for nothing, is empty whatever its question; a null question has no
    language and can't be copied. Lists have no defect. Repeated rows each count, extra columns don't matter, whole texts are
    read. The field is fitted on all pairs of samples first; then one pass over the rows, without a shuffle."""
    spark = samples.sparkSession
    ship_code(spark)
    fitted = spark.sparkContext.broadcast(fit_all(samples))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = fitted.value
        sheets = Sheets.of(known, Reader)
        reader = sheets.reader
        for f in frames:
            found: list[str | None] = [None] * len(f)
            at, read = [], []
            for k, (q, a) in enumerate(pairs_of(f)):
                if is_nothing(a) or not (clauses := clauses_of(a)):
                    found[k] = "empty"
                    continue
                at.append(k)
                read.append((q, clauses))
            if at:
                items, features, sizes = sheets.read(read)
                tags = model.decode(model.emissions(items, features, sizes.sum()), sizes)
                ends = np.cumsum(sizes)
                some = np.add.reduceat(tags, ends - sizes) > 0
                for k in np.flatnonzero(some).tolist():
                    q, clauses = read[k]
                    found[at[k]] = decide(clauses, tags[ends[k] - sizes[k] : ends[k]].tolist(), *reader.question(q)[1:3])
            keep = [k for k, d in enumerate(found) if d]
            yield pd.DataFrame({c: f[c].to_numpy(dtype=object)[keep] for c in ("field_name", "row_key", "turn")} | {"defect": np.array([found[k] for k in keep], dtype=object)})

    return spread(answers(samples, predictions)).mapInPandas(run, "field_name string, row_key long, turn int, defect string")


def defect_report(samples: DataFrame, predictions: DataFrame, found: DataFrame) -> DataFrame:
    """(field_name, defect, n) of each field and defect, and the number of all answers as defect `any answer`."""
    total = answers(samples, predictions).groupBy("field_name").agg(F.lit("any answer").alias("defect"), F.count(F.lit(1)).alias("n"))
    return found.groupBy("field_name", "defect").agg(F.count(F.lit(1)).alias("n")).unionByName(total)
