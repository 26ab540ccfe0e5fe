"""The features of `broken_pairs.Reader` for many answers at once: texts as arrays of code points, words as numbers, and one pass of
numpy for each kind of feature. What is rare (copies, endings, Han words) is left to the reader itself."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import regex

from benthos.llm.crf import ranges

_WORD_SIGN = re.compile(r"[^\W\d_]")
_SCRIPT_NAMES = ("latin", "cyrillic", "kana", "han", "hangul", "arabic", "greek", "other")
_SCRIPT_OF = [regex.compile(x) for x in (r"\p{Latin}", r"\p{Cyrillic}", r"[\p{Hiragana}\p{Katakana}]", r"\p{Han}", r"\p{Hangul}", r"\p{Arabic}", r"\p{Greek}")]
_LETTER, _NO_WORD, _NUMERAL = regex.compile(r"\p{L}"), re.compile(r"[\W_]"), re.compile(r"\d")
_VOTED = (re.compile(r"[一-鿿]"), re.compile(r"[а-яё]", re.I))
#: By code point: 255 if not looked at yet, else the script (7: none of them); whether it is a letter, Han or Cyrillic as languages
#: are told by or stands in words, and what it is in a text of letters alone: -1 left out, 32 white space.
_SCRIPT = np.full(0x110000, 255, np.uint8)
_FLAGS = np.zeros(0x110000, np.uint8)
_BARE = np.zeros(0x110000, np.int32)
#: Answers looked at together: their arrays fit a core's cache.
AT_ONCE = 4000
#: Bits of a packed sum; six languages and one more fit, as clauses of more words are summed one by one.
BITS = 9
#: Signs of a language up to which its trigrams are looked up in a table.
SIGNS = 600


def codes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    new = codes[_SCRIPT[codes] == 255]
    for code in np.unique(new).tolist():
        c = chr(code)
        _FLAGS[code] = bool(_LETTER.match(c)) + 2 * bool(_VOTED[0].match(c)) + 4 * bool(_VOTED[1].match(c)) + 8 * bool(_WORD_SIGN.match(c))
        _BARE[code] = -1 if _NUMERAL.match(c) else 32 if _NO_WORD.match(c) else code
        _SCRIPT[code] = next((k for k, p in enumerate(_SCRIPT_OF) if p.match(c)), 7)
    return codes


def words_of(texts: list[str], joined_by: tuple[int, ...] = ()) -> tuple[list[str], np.ndarray]:
    """(words, number by text): all runs of letters in texts of one line; joined_by: code points that part no word between letters."""
    codes = codes_of("\n".join(texts) + "\n")
    letter = _FLAGS[codes] & 8 > 0
    if joined_by:
        link = np.isin(codes, joined_by)
        link[1:-1] &= letter[:-2] & letter[2:]
        link[0] = False
        letter |= link
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    lines = np.flatnonzero(codes == 10) + 1
    lines[1:], lines[0] = lines[:-1].copy(), 0
    return np.where(letter, codes, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").split(), np.add.reduceat(starts, lines, dtype=np.int64)


def uniques(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=keys[:1] - 1) > 0]


def lettered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, starts with the end): each text in lower case without digits, other signs as single spaces, two spaces before
    and one after, as Trigrams reads it."""
    codes = codes_of("\n".join(x.replace("\n", " ") for x in texts).lower() + "\n")
    bare = _BARE[codes]
    bare[codes == 10] = 10
    bare = bare[bare >= 0]
    gap = (bare == 32) | (bare == 10)
    drop = np.zeros(len(bare), bool)  # a space after a gap, or before an end
    drop[1:] = (bare[1:] == 32) & gap[:-1]
    drop[:1] = bare[:1] == 32
    bare = bare[~drop]
    drop = np.zeros(len(bare), bool)
    drop[:-1] = (bare[:-1] == 32) & (bare[1:] == 10)
    bare = bare[~drop]
    ends = bare == 10
    out = np.repeat(bare, np.where(ends, 3, 1))
    out = np.concatenate([[32, 32], out[:-2]])
    out[out == 10] = 32
    at = np.flatnonzero(ends)
    return out, np.concatenate([[0], at + 1 + 2 * np.arange(1, len(at) + 1)])


def triples_in(texts: list[str]) -> dict[str, int]:
    """How often each three signs stand in the texts."""
    if not texts:
        return {}
    codes, starts = lettered(texts)
    codes = codes.astype(np.int64)
    ok = np.ones(len(codes) - 2, bool)
    for back in (1, 2):
        ok[starts[1:-1] - back] = False
    keys, n = np.unique(((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[ok], return_counts=True)
    mask = (1 << 21) - 1
    return {chr(k >> 42) + chr(k >> 21 & mask) + chr(k & mask): c for k, c in zip(keys.tolist(), n.tolist())}


class TrigramTable:
    """Trigrams.mean of many texts at once."""

    def __init__(self, model):
        self.model, signs = model, sorted(model.one)
        self.signs = None
        if len(signs) >= SIGNS:
            return
        a = len(signs) + 1
        at = {c: k + 1 for k, c in enumerate(signs)}
        self.signs = np.zeros(0x110000, np.uint16)
        self.signs[[ord(c) for c in signs]] = np.arange(1, a)
        one = np.array([model.floor, *((model.one[c] or model.floor) for c in signs)])
        two = np.repeat((one - 1.5)[None], a, 0)
        for g, x in model.two.items():
            if x:
                two[at[g[0]], at[g[1]]] = x
        self.rows = np.repeat(np.arange(a, dtype=np.int32)[None], a, 0)  # by the first two signs
        heads = sorted({g[:2] for g in model.three if g[0] in at and g[1] in at})
        for k, g in enumerate(heads):
            self.rows[at[g[0]], at[g[1]]] = a + k
        self.value = np.concatenate([two, two[[at[g[1]] for g in heads]]] if heads else [two]) - 0.7
        for g, x in model.three.items():
            if x and g[0] in at and g[1] in at:
                self.value[self.rows[at[g[0]], at[g[1]]], at[g[2]]] = x

    def means(self, texts: list[str], codes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of the texts whose places are given; codes, starts: of all texts, by lettered()."""
        if self.signs is None:
            return np.array([np.nan if (m := self.model.mean(texts[i].lower())) is None else m for i in which.tolist()], float)
        sizes = (starts[1:] - starts[:-1])[which]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        at = self.signs[codes[np.repeat(starts[which] - first, sizes) + np.arange(sizes.sum())]]
        v = np.zeros(len(at))
        v[:-2] = self.value[self.rows[at[:-2], at[1:-1]], at[2:]]
        v[first[1:] - 1] = v[first[1:] - 2] = 0
        return np.where(sizes < LETTERS_LEAST, np.nan, np.add.reduceat(v, first) / (sizes - 2)) if len(sizes) else np.zeros(0)


def table_of(model) -> TrigramTable:
    """Its table, made once in a process."""
    if (found := model.__dict__.get("table")) is None:
        found = model.table = TrigramTable(model)
    return found


def usual_of(model):
    """A function that says how many of some texts are long enough, and the sum of their means and of the squares of these."""
    table = table_of(model)

    def sums(texts: list[str]) -> tuple[float, float, float]:
        if not texts:
            return 0.0, 0.0, 0.0
        means = table.means(texts, *lettered(texts), np.arange(len(texts)))
        means = means[~np.isnan(means)]
        return float(len(means)), float(means.sum()), float((means * means).sum())

    return sums


LETTERS_LEAST = 13


_LAST: list[Sheets] = []


class _Words(dict):
    """Numbers of words, new ones added."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Sheets:
    """Features by a reader. What is known of a word is kept for when it comes again."""

    def __init__(self, reader):
        from benthos.llm import broken_pairs as B

        self.B, self.reader, self.known = B, reader, reader.known
        self.tables = {k: table_of(t) for k, t in self.known.trigrams.items()}
        self.heard = sorted(k for k, x in self.known.words.items() if x)
        self._new()

    @classmethod
    def of(cls, known, reader_of) -> Sheets:
        """Those of what is known; the last are kept for the next task of this process."""
        if not _LAST or _LAST[0].known is not known:
            _LAST[:] = [cls(reader_of(known))]
        return _LAST[0]

    def _new(self) -> None:
        self.words = _Words()
        self.words["\n"] = 0
        self.lows: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.low, self.length = np.zeros((2, 1), np.int64)
        self.lex = np.zeros(1, np.int64)
        self.odds = np.zeros(1)
        self.told, self.common = np.zeros((2, 1), bool)
        # sums of votes by language, and of words that can be new and that are by language, each in BITS bits
        self.votes, self.as_first, self.as_other = np.zeros((3, 1), np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers, those of words not seen before added."""
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        for w in self.words.new:
            low = w.lower()
            votes = sum(1 << BITS * k for k in self.B._VOTES.get(low, ()))
            told = self.known.refusing.get(low)
            fresh = 0
            if len(low) > 2 and low.islower():  # as a first word; else also only as it is
                fresh = 1 + sum(1 << BITS * (k + 1) for k, x in enumerate(self.heard) if low not in self.known.words[x])
            self.rows.append((self.lows.setdefault(low, len(self.lows)), self.B._lex("r", low) if told is not None else 0, told or 0.0, told is not None, low in self.known.common, votes, fresh, fresh if w.islower() else 0, len(w)))
        if self.rows:
            names = ("low", "lex", "odds", "told", "common", "votes", "as_first", "as_other", "length")
            for name, x in zip(names, zip(*self.rows)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.array(x, old.dtype)]))
            self.rows, self.words.new = [], []
        return numbers

    def said(self, texts: list[str]) -> Counter:
        """In how many texts each word of refusals stands, and under "" how many different words all texts have."""
        n: Counter = Counter()
        plain = [t for t in texts if t.isascii() or not ("İ" in t or _VOTED[0].search(t))]
        if plain:
            words, sizes = words_of([t.replace("\n", " ") for t in plain])
            used = self._numbers(words)
            pairs = uniques((np.repeat(np.arange(len(plain)), sizes) << 32) | self.low[used]) & 0xFFFFFFFF
            n[""] = len(pairs)
            names = list(self.lows)
            told = np.unique(self.low[used[self.told[used]]])
            n.update({names[k]: c for k, c in zip(told.tolist(), np.bincount(pairs, minlength=len(names))[told].tolist())})
        for t in texts if len(plain) < len(texts) else ():
            if not t.isascii() and ("İ" in t or _VOTED[0].search(t)):
                words = set(self.B.pieces_of(t.lower()))
                n[""] += len(words)
                n.update(w for w in words if w in self.known.refusing)
        return n

    def clauses(self, texts: list[str]) -> dict:
        """What is known of different clauses by themselves."""
        B, n = self.B, len(texts)
        if len(self.words) > 1_000_000:
            self._new()
        words, n_words = words_of(texts)
        w = self._numbers(words)
        w_clause, w_start = np.repeat(np.arange(n), n_words), np.cumsum(n_words) - n_words
        head = w_start[n_words > 0]
        boxes = np.array(["[" in t or "{" in t for t in texts], bool)

        # scripts and languages; in ASCII all letters are Latin
        script, letters = np.zeros(n, np.int64), np.zeros(n, np.int64)
        letters[n_words > 0] = np.add.reduceat(self.length[w], head) if len(head) else 0
        han, cyrillic, dotted = np.zeros((3, n), np.int64)
        wide = np.array([i for i, t in enumerate(texts) if not t.isascii()], np.int64)
        if m := len(wide):
            codes = codes_of("\n".join([texts[i] for i in wide.tolist()]) + "\n")
            c_clause = np.repeat(np.arange(m), np.diff(np.flatnonzero(codes == 10), prepend=-1))
            fl = _FLAGS[codes]
            counts = np.bincount(c_clause * 8 + _SCRIPT[codes], minlength=8 * m).reshape(m, 8)
            counts[:, 7] = np.bincount(c_clause[fl & 1 > 0], minlength=m) - counts[:, :7].sum(1)
            script[wide], letters[wide] = counts.argmax(1), counts.max(1)
            kana = (counts[:, 2] > 1) & (counts[:, 2] * 6 > counts[:, 3])
            script[wide[kana]], letters[wide[kana]] = 2, (counts[:, 2] + counts[:, 3])[kana]
            han[wide], cyrillic[wide], dotted[wide] = (np.bincount(c_clause[x], minlength=m) for x in (fl & 2 > 0, fl & 4 > 0, codes == 0x130))
        script[boxes], letters[boxes] = 8, 0
        votes = self._sums(self.votes[w], n_words, 4)
        lang = votes.argmax(1)
        votes.sort(1)
        margin = votes[:, 3] - votes[:, 2]
        lang[margin == 0] = -1
        zh = (han > 1) & (han * 3 >= cyrillic)
        ru = ((han > 1) | (cyrillic > 3)) & ~zh
        lang[zh], margin[zh], lang[ru], margin[ru] = 5, han[zh], 4, cyrillic[ru] // 4 + 1
        none = boxes | ((n_words < 3) & (lang < 4))
        lang[none], margin[none] = -1, 0

        # words of refusals; Han and letters that fall apart in lower case are the reader's
        by_hand = np.flatnonzero((han > 0) | (dotted > 0))
        hand = np.zeros(n, bool)
        hand[by_hand] = True
        told = np.flatnonzero(self.told[w])
        told = told[~hand[w_clause[told]]]
        t_clause, t_word = w_clause[told], w[told]
        n_told = np.bincount(t_clause, minlength=n)
        aside = np.where(n_words < 3, -1.0, (np.bincount(t_clause, self.odds[t_word], n) - n_words + n_told) / np.maximum(n_words, 1))
        pairs = uniques((t_clause << 32) | self.low[t_word])
        lex = np.zeros(len(self.lows), np.int64)
        lex[self.low[t_word]] = self.lex[t_word]
        runs = [(pairs >> 32, lex[pairs & 0xFFFFFFFF])]
        for i in by_hand.tolist():
            low = texts[i].lower()
            pieces = B.pieces_of(low)
            aside[i] = B.aside_of(pieces, self.known.refusing, low)
            own = [B._lex("r", x) for x in dict.fromkeys(pieces) if x in self.known.refusing]
            runs.append((np.full(len(own), i), np.array(own, np.int64)))

        fresh = self.as_other[w]
        fresh[head] = self.as_first[w[head]]
        sums = self._sums(fresh, n_words, 1 + len(self.heard))
        sums[boxes | (n_words < 3)] = 0
        return {"n_words": n_words, "words": w, "start": w_start, "lang": lang, "margin": margin, "script": script, "letters": letters, "boxes": boxes, "aside": aside, "told": runs, "n_fresh": sums[:, 0], "new": {k: sums[:, 1 + j] for j, k in enumerate(self.heard)}}

    @staticmethod
    def _sums(values: np.ndarray, n_words: np.ndarray, fields: int) -> np.ndarray:
        """(clauses, fields): the sums over the words of each clause of the numbers that stand BITS bits each in the values."""
        out = np.zeros((len(n_words), fields), np.int64)
        some = np.flatnonzero(n_words)
        if not len(some):
            return out
        starts = (np.cumsum(n_words) - n_words)[some]
        mask, per = (1 << BITS) - 1, 63 // BITS if n_words.max() < 1 << BITS else 1
        for at in range(0, fields, per):
            part = (values >> BITS * at) & ((1 << BITS * min(per, fields - at)) - 1) if per < fields else values
            got = np.add.reduceat(part, starts)
            for k in range(min(per, fields - at)):
                out[some, at + k] = (got >> BITS * k) & mask if per > 1 else got
        return out

    def read(self, answers: list[tuple[str | None, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, features, number of clauses by answer): the features of all clauses, which are numbered through, in any order."""
        items, features, sizes, n = [], [], [], 0
        for at in range(0, len(answers), AT_ONCE):
            i, f, some = self._read(answers[at : at + AT_ONCE])
            items.append(i + n)
            features.append(f)
            sizes.append(some)
            n += some.sum()
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, features, sizes))

    def _read(self, answers: list[tuple[str | None, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        B, reader = self.B, self.reader
        n_clauses = np.array([len(cs) for _, cs in answers], np.int64)
        at_clause: dict[str, int] = {}
        at_question: dict[str | None, int] = {}
        c = np.array([at_clause.setdefault(x, len(at_clause)) for _, cs in answers for x in cs], np.int64)
        q = np.repeat(np.array([at_question.setdefault(x, len(at_question)) for x, _ in answers], np.int64), n_clauses)
        n, texts = len(c), list(at_clause)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n_clauses
        of = self.clauses(texts)
        asked = [reader.question(x) for x in at_question]
        # pairs of question and clause, that the same features come out for
        keys, place = np.unique(q * len(texts) + c, return_inverse=True)
        kq, kc = keys // len(texts), keys % len(texts)
        expected = np.array([x[0] for x in asked], np.int64)[kq]
        written = np.array([-1 if x[4] is None else _SCRIPT_NAMES.index(x[4]) for x in asked], np.int64)[kq]
        some = np.array([bool(x[2]) for x in asked])[kq]
        n_words, lang, margin, letters, script, boxes = (of[k][kc] for k in ("n_words", "lang", "margin", "letters", "script", "boxes"))
        runs: list[tuple[np.ndarray, np.ndarray]] = []

        def add(mask: np.ndarray, feature: int) -> None:
            at = np.flatnonzero(mask)
            runs.append((at, np.full(len(at), feature)))

        add(np.ones(len(keys), bool), B._BIAS)
        add(n_words == 0, B._NO_WORDS)
        add((n_words > 0) & (n_words <= 3), B._SHORT)
        add(boxes, B._BOX)
        aside = of["aside"][kc]
        for k, f in enumerate(B._ASIDE):
            add(aside > k, f)
        order = np.argsort(kc, kind="stable")
        from_, to = np.searchsorted(kc[order], np.arange(len(texts))), np.searchsorted(kc[order], np.arange(len(texts)), "right")
        for at, f in of["told"]:
            times = (to - from_)[at]
            runs.append((order[ranges(from_[at], times)], np.repeat(f, times)))
        n_fresh = of["n_fresh"][kc]
        for k in self.heard:
            mine = (n_fresh > 0) & (expected == k)
            share = of["new"][k][kc] / np.maximum(n_fresh, 1)
            for f, least in zip(B._NEW, (0.2, 0.35, 0.6)):
                add(mine & (share >= least), f)
        other = (written >= 0) & (letters > 3) & (letters > 0) & (script != written) & ((script != 0) | (n_words > 3))
        add(other, B._OTHER_SCRIPT)
        modelled = np.isin(expected, list(self.tables))
        self._reading(texts, np.flatnonzero(~other & modelled & ~boxes & (n_words > 1) & (letters >= B.LETTERS) & ~((lang == expected) & (margin > 1))), kc, expected, letters, runs)

        # words of the question
        asks, says = [], []
        for k, x in enumerate(asked):
            known = [y for y in map(self.lows.get, x[2]) if y is not None]
            asks += [k] * len(known)
            says += known
        base = max(1, len(self.lows))
        there = np.sort(np.array(asks, np.int64) * base + np.array(says, np.int64)) if asks else np.array([-1])
        w_at = ranges(of["start"][kc], n_words)
        w_key = np.repeat(np.arange(len(keys)), n_words)
        w = of["words"][w_at]
        want = kq[w_key] * base + self.low[w]
        found = there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want
        shared = np.bincount(w_key[found], minlength=len(keys))
        found[self.common[w]] = False
        apart = np.bincount(w_key[found], minlength=len(keys)) == 0
        add(some & (n_words > 2) & apart, B._APART)
        same = (lang == expected) | (expected < 0)
        add(lang < 0, B._LANG_NONE)
        add((lang >= 0) & same, B._LANG_SAME)
        unlike = (lang >= 0) & ~same
        add(unlike & (margin > 1), B._LANG_OTHER)
        add(unlike & (margin > 1) & ((lang > 3) | (expected > 3)), B._SCRIPT)
        add(unlike & (margin <= 1), B._LANG_OTHER_WEAK)
        share = np.where(some & (n_words > 0), shared / np.maximum(n_words, 1), -1.0)
        high = (share > 0.8) | ((share >= 0) & (lang == 5) & (expected == 5))
        add(high, B._OVERLAP_HIGH)
        add(~high & (share > 0.5), B._OVERLAP_MID)
        echoes = []
        for k in np.flatnonzero(high).tolist():
            if f := B.echo(texts[kc[k]], asked[kq[k]][1]):
                echoes.append((k, f))
        runs.append((np.array([k for k, _ in echoes], np.int64), np.array([f for _, f in echoes], np.int64)))

        # spread over the clauses, and what their place tells
        k_at, k_f = (np.concatenate([np.asarray(r[j], np.int64) for r in runs]) for j in (0, 1))
        by = np.argsort(k_at, kind="stable")
        k_f, many = k_f[by], np.bincount(k_at, minlength=len(keys))
        begin = np.concatenate([[0], np.cumsum(many)[:-1]])
        items, features = [np.repeat(np.arange(n), many[place])], [k_f[ranges(begin[place], many[place])]]
        ends = np.cumsum(n_clauses)[n_clauses > 0] - 1
        sizes = n_clauses[n_clauses > 0]
        for at, f in ((ends - sizes + 1, B._FIRST), (ends, B._LAST), (ends[sizes == 1], B._ONLY)):
            items.append(at)
            features.append(np.full(len(at), f))
        boxed = np.array([x[3] for x in asked], bool)
        kept: dict[tuple[int, bool], list[int]] = {}
        more_i: list[int] = []
        more_f: list[int] = []
        for i, k, box, some_words in zip(ends.tolist(), c[ends].tolist(), boxed[q[ends]].tolist(), (of["n_words"][c[ends]] > 0).tolist()):
            if (f := kept.get((k, box))) is None:
                f = kept[k, box] = reader.ending(texts[k], some_words, box)
            more_i += [i] * len(f)
            more_f += f
        return np.concatenate([*items, np.array(more_i, np.int64)]), np.concatenate([*features, np.array(more_f, np.int64)]), n_clauses

    def _reading(self, texts: list[str], at: np.ndarray, kc: np.ndarray, expected: np.ndarray, letters: np.ndarray, runs: list) -> None:
        if not len(at):
            return
        B = self.B
        used, place = np.unique(kc[at], return_inverse=True)
        own = [texts[i] for i in used.tolist()]
        codes, starts = lettered(own)
        mean = np.full(len(at), np.nan)
        for k, t in self.tables.items():
            mine = np.flatnonzero(expected[at] == k)
            if len(mine):
                mean[mine] = t.means(own, codes, starts, place[mine])
        usual, spread = (np.array([getattr(self.known.trigrams[k], x) if k in self.known.trigrams else 1.0 for k in range(max(self.tables) + 1)])[expected[at]] for x in ("usual", "spread"))
        z = np.nan_to_num((usual - mean) / (spread * np.maximum(1.0, np.sqrt(40 / letters[at]))))
        for f, least in zip(B._UNLIKE, (1.5, 2.5, 4, 6)):
            runs.append((at[z > least], np.full((z > least).sum(), f)))
        odd = np.flatnonzero(z > 1.5)
        gain = np.full(len(odd), -99.0)
        for k, t in self.tables.items():
            mine = np.flatnonzero(expected[at[odd]] != k)
            if len(mine):
                gain[mine] = np.fmax(gain[mine], t.means(own, codes, starts, place[odd[mine]]))
        gain -= mean[odd]
        for f, least in zip(B._LIKE_OTHER, (0.1, 0.6)):
            runs.append((at[odd[gain > least]], np.full((gain > least).sum(), f)))
