"""Pages made of repeated keywords, link lists or product tags instead of sentences.

Texts become tokens, and tokens blocks of up to 32 words of a line; everything is computed
over whole Arrow batches, never word by word in Python. Three scans of the pages follow each
other; what passes between them is small and adds up (counts and histograms).

1. Function words are learnt, for any language: words that occur in many documents' prose and
   are much rarer in lists than in prose.
2. The usual measures of each language are taken from histograms over all its pages, and
   give its thresholds.
3. Each block is judged. It is a list where function words are missing. A list is junk if the
   share of its words in recurring words, bigrams or trigrams, the density of its separators
   or of links among its words, or the run of words without any function word is above the
   threshold, or if it holds the page's top word and that word's share is. With function words
   or without, a block is junk if too few of its words are distinct, and a line if it recurs
   and such lines make up too much of the page. Links, tags and codes are junk by form.

A page is spam if more than half of its characters are junk.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.session import materialize

# How links are written, plainly or disguised, and the endings of bare hosts
# (common ones, and those reserved for examples).
_DOT = r"(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|[ \t]+dot[ \t]+)"
_LABEL = r"[a-z0-9][a-z0-9-]*"
_LEAD = r"(?:(?:>>|[-=]>|\bgo to\b|\bvisit\b|\bhxxps?:)[ \t]*)*"
_PATH = r"(?:[ \t]*(?:/|\bslash\b|\bp/|\bpage\b)[ \t]*[a-z0-9_-]*[ \t]*[0-9]*)*"
_ENDING = "com|org|net|info|biz|edu|gov|tv|io|co|me|app|dev|vn|fr|uk|de|eu|us|example|test|invalid"
_LINKS = (
    r"<a\s[^>]*>[^<]*(?:</a>)?",
    r"\[[^\]\n]*\]\(\S+",
    r"[^\n.!?<>]*[ \t][-=]>[ \t]*(?:https?:|www\.)\S+",
    rf"{_LEAD}(?:(?:https?|hxxps?|ftp)://\S+|www\.\S+)",
    rf"{_LEAD}\b{_LABEL}(?:{_DOT}{_LABEL})+{_PATH}",
    rf"{_LEAD}\b{_LABEL}(?:\.{_LABEL})*\.(?:{_ENDING})\b(?:/\S*)?{_PATH}",
    r"#[\p{L}_][\p{L}\p{M}\p{N}_]*",
)
_CODES = (
    r"\b[a-z_]+:[^\s:,/]+",
    r"\b[A-Z]{2,}-?[0-9]{3,}\b",
    r"[$€£₫] ?[0-9]+(?:[.,][0-9]+)?",
    r"\b[0-9]+(?:[.,][0-9]+)? ?(?:[$€£₫]|USD\b|EUR\b|VND\b)",
)
#: What is junk by its form: links, hashtags, key:value tags, product codes, prices. This syntax has no backtracking.
FORM = "(?i:" + "|".join(_LINKS) + ")|" + "|".join(_CODES)

# Private characters that stand for a form, the end of a sentence and the end of a line.
_OPEN, _CLOSE, _FORM, _STOP, _LINE = "", "", "", "", ""
_HARD, _SOFT = "|", ","

#: Words of a block at most, and of a sentence that is a block of its own at least.
BLOCK, SENTENCE = 32, 8
#: Phrases recur if they occur RECURS times within so many words; single words within fewer.
RECURS, PHRASE_WINDOW, WORD_WINDOW = 3, 256, 128
#: Words of a prose block at least, and its share of distinct words at least; less than LOOSE make a list.
PROSE, DISTINCT, LOOSE = 9, 0.75, 0.5
#: A function word is in the prose of this share of documents at least, and so much more frequent there than in lists.
COMMON, CONTRAST = 0.1, 3.0
#: A language is learnt if it is delivered with this share of the documents at least, so there are at most 1,000.
LANGUAGE_SHARE = 0.001
#: Function words (distinct) that tell the language of a page.
TELLING = 3
#: Blocks, lines of lists and pages of fewer words say nothing about the usual measures.
USUAL_BLOCK, USUAL_LIST, USUAL_PAGE = 16, 3, 24
#: Words of a list in which single words are looked for, and words without function words that are a list by that alone.
LIST_WORDS, LIST_RUN = 10, 60
#: Forms per word above which a list, and any block, is a list of links.
FORMS = 1 / 8, 1 / 5
#: Passages of so many words that occur twice are copies.
COPY = 6
#: Records (timetables, scores, credits) are lines of so many words at most that hold a number.
RECORD_WORDS = 12
#: Above this share of junk characters a page is spam.
SPAM_SHARE = 0.5
#: Bytes of text that are handled at once, unless one text is larger.
SLICE_BYTES = 4 * 2**20
#: Bins of the histograms of the measures, which all lie between 0 and 1.
BINS = 200

#: Thresholds by measure as (part of the usual value, part of the way from there to 1).
LIMITS = {
    "function": (0.4, 0.0),
    "distinct": (0.5, 0.0),
    "word": (1.0, 0.5),
    "bigram": (1.0, 0.6),
    "trigram": (1.0, 0.5),
    "separator": (1.0, 0.15),
    "line": (1.0, 0.5),
    "top": (1.0, 0.25),
}
#: The usual value is this quantile over the pages; where not given the lower quartile, as many lists may be spam.
QUANTILE = {"function": 0.5, "distinct": 0.5}
#: Used where a language has nothing to calibrate on.
USUAL = {"function": 0.3, "distinct": 0.9}
#: The pooled language, for pages whose language nothing tells, and the usual code for "not determined".
POOLED, UNDETERMINED = "*", "und"


@dataclass
class Tokens:
    """The words of a slice of texts, in order, and the blocks they form."""

    n: int
    names: pa.Array
    code: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    block: np.ndarray
    length: np.ndarray
    number: np.ndarray
    first: np.ndarray
    forms: np.ndarray  # per block, as the next two
    hard: np.ndarray
    soft: np.ndarray
    line_forms: np.ndarray
    line_separators: np.ndarray
    form_chars: np.ndarray  # per document, as the next one
    separators: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.first)

    def per_block(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.block, weights=weights, minlength=self.blocks)

    def per_doc(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=weights, minlength=self.n)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _sorted_once(values: np.ndarray) -> np.ndarray:
    """The distinct values, in order."""
    values = np.sort(values)
    return values[_starts(values)] if len(values) else values


def _flags(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def tokenise(texts: pa.Array) -> Tokens:
    """Words, forms and separators of texts; null is as empty. Punctuation counts only within forms."""
    n = len(texts)
    # Arrow's own normalization does not compose characters.
    text = pa.array([unicodedata.normalize("NFC", t or "") for t in texts.to_pylist()], pa.string())
    text = pc.replace_substring_regex(text, f"[{_OPEN}-{_LINE}]", " ")
    text = pc.replace_substring_regex(text, FORM, f"{_OPEN}\\0{_CLOSE}")
    # Split at the marks, every second piece of a text is a form.
    pieces = pc.split_pattern_regex(text, f"[{_OPEN}{_CLOSE}]")
    size = np.diff(pieces.offsets.to_numpy())
    odd = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) % 2 == 1
    forms = pc.utf8_length(pc.replace_substring_regex(pc.filter(pieces.flatten(), pa.array(odd)), r"\s+", "")).to_numpy()
    form_chars = np.bincount(np.repeat(np.arange(n), size)[odd], weights=forms, minlength=n).astype(np.int64)
    text = pc.replace_substring_regex(text, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", f" {_FORM} ")
    text = pc.replace_substring(text, "\n", f" {_LINE} ")
    text = pc.replace_substring_regex(text, r"[.!?…]+[\"”»’)\]]*(?:[ \t]|$)", f" {_STOP} ")
    text = pc.replace_substring_regex(text, r"[|»«·•›‹~_¦/]|[ \t][-–—][ \t]", f" {_HARD} ")
    text = pc.replace_substring_regex(text, "[,;]", f" {_SOFT} ")
    text = pc.replace_substring_regex(text, f"[^\\p{{L}}\\p{{M}}\\p{{N}} {_HARD}{_SOFT}{_FORM}-{_LINE}]+", " ")
    listed = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(text)))
    coded = listed.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    doc = np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy()))
    real = _flags(pc.not_equal(names, ""))[code]
    code, doc = code[real], doc[real]
    form, stop, end, hard, soft = (_flags(pc.equal(names, mark))[code] for mark in (_FORM, _STOP, _LINE, _HARD, _SOFT))
    word = ~(form | stop | end | hard | soft)
    fresh = _starts(doc) if len(doc) else np.zeros(0, bool)
    line = np.cumsum(end | fresh)
    lines = int(line[-1]) + 1 if len(line) else 1
    sentence = np.cumsum(end | stop | fresh)[word]
    out_code, out_doc, out_line = code[word], doc[word], line[word]
    m = len(out_code)
    # Short pieces between stops belong together, others are sentences of their own.
    begin = np.flatnonzero(_starts(sentence)) if m else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, m))
    long = size >= SENTENCE
    apart = _starts(out_line[begin]) if m else np.zeros(0, bool)
    apart[1:] |= long[1:] | long[:-1]
    part = np.repeat(np.cumsum(apart), size)
    begin = np.flatnonzero(_starts(part)) if m else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.append(begin, m)), np.diff(np.append(begin, m)))
    at = np.arange(m) - np.repeat(begin, np.diff(np.append(begin, m)))
    # Blocks of a part are alike in size.
    many = -(-size // BLOCK)
    heads = (at == 0) | (at * many // np.maximum(size, 1) != (at - 1) * many // np.maximum(size, 1))
    block = np.cumsum(heads) - 1
    blocks = int(heads.sum())
    before = np.cumsum(word) - 1

    def near(mask: np.ndarray) -> np.ndarray:
        """Marks per block: they belong to the word before them in their line, else to the next."""
        if not m:
            return np.zeros(0)
        left, right = np.clip(before[mask], 0, m - 1), np.clip(before[mask] + 1, 0, m - 1)
        to_left = (before[mask] >= 0) & (out_line[left] == line[mask])
        to_right = ~to_left & (out_line[right] == line[mask])
        return np.bincount(np.concatenate([block[left[to_left]], block[right[to_right]]]), minlength=blocks)

    return Tokens(
        n, names, out_code, out_doc, out_line, block, pc.utf8_length(names).to_numpy()[out_code], _flags(pc.match_substring_regex(names, r"^\p{N}+$"))[out_code],
        np.flatnonzero(heads), near(form), near(hard), near(soft), np.bincount(line[form], minlength=lines), np.bincount(line[hard | soft], minlength=lines),
        form_chars, np.bincount(doc[hard | soft], minlength=n),
    )


def _mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit key of rows of numbers; unlike rows share one with odds of about 1 in 2^64."""
    key = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return key


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Positions by key, then by position; two unstable sorts are much faster than a stable one."""
    order = np.argsort(keys)
    run = np.cumsum(_starts(keys[order])) if len(keys) else order
    return np.sort(run << 32 | order) & 0xFFFFFFFF


def _recurring(keys: np.ndarray, at: np.ndarray, window: int, times: int) -> np.ndarray:
    """Which keys are one of ``times`` equal ones within ``window`` positions."""
    order = _in_order(keys)  # positions ascend already
    key, place = keys[order], at[order]
    hot = np.zeros(len(key), bool)
    k = times - 1
    if len(key) > k:
        found = np.flatnonzero((key[k:] == key[:-k]) & (place[k:] - place[:-k] <= window))
        for i in range(times):
            hot[found + i] = True
    out = np.zeros(len(key), bool)
    out[order] = hot
    return out


def _word_times(t: Tokens) -> np.ndarray:
    """By word: how often it occurs on its page; 0 for numbers."""
    times = np.zeros(len(t.code), np.int64)
    plain = np.flatnonzero(~t.number)
    key = t.doc[plain].astype(np.int64) * (len(t.names) + 1) + t.code[plain]
    order = _in_order(key)
    begin = np.flatnonzero(_starts(key[order])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    times[plain[order]] = np.repeat(size, size)
    return times


def recurring_phrases(t: Tokens, words: int, window: int, times: int = RECURS, seen: np.ndarray | None = None) -> np.ndarray:
    """By word: whether it lies in a phrase of ``words`` words of one line that recurs. Numbers are skipped.

    ``seen`` are the _word_times(), if they are known: a phrase cannot recur more often than its words.
    """
    seen = _word_times(t) if seen is None else seen
    plain = np.flatnonzero(~t.number)
    covered = np.zeros(len(t.code), bool)
    n = len(plain) - words + 1
    if n < times:
        return covered
    code, line, doc, often = t.code[plain], t.line[plain], t.doc[plain], seen[plain] >= times
    able = line[:n] == line[words - 1 :]
    for i in range(words):
        able &= often[i : n + i]
    at = np.flatnonzero(able)
    keys = _mix(doc[at], *[code[at + i] for i in range(words)])
    hot = at[_recurring(keys, plain[at], window, times)]
    for i in range(words):
        covered[plain[hot + i]] = True
    return covered


def recurring_lines(t: Tokens) -> np.ndarray:
    """By word: whether its line occurs RECURS times on the page, numbers aside."""
    plain = np.flatnonzero(~t.number)
    covered = np.zeros(len(t.code), bool)
    if not len(plain):
        return covered
    begin = np.flatnonzero(_starts(t.line[plain]))
    size = np.diff(np.append(begin, len(plain)))
    at = np.arange(len(plain)) - np.repeat(begin, size)
    keys = _mix(t.doc[plain][begin], np.add.reduceat(_mix(t.code[plain], at), begin))
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    covered[plain] = np.repeat(times[which] >= RECURS, size)
    return covered


def _distinct_shares(t: Tokens, plain_words: np.ndarray) -> np.ndarray:
    width = len(t.names) + 1
    pairs = _sorted_once((t.block.astype(np.int64) * width + t.code)[~t.number])
    return np.bincount(pairs // width, minlength=t.blocks) / np.maximum(plain_words, 1)


class Lexicon:
    """Function words by language; the pooled language has those of all."""

    def __init__(self, words: dict[str, list[str]]) -> None:
        self.languages = sorted(words)
        known = sorted({w for each in words.values() for w in each})
        self.known = pa.array(known, pa.string())
        self.table = np.zeros((len(known) + 1, len(self.languages) + 1), bool)
        place = {w: i for i, w in enumerate(known)}
        for j, language in enumerate(self.languages):
            for w in words[language]:
                self.table[place[w], j] = True
        self.table[:-1, -1] = True

    def flags(self, names: pa.Array) -> np.ndarray:
        """By name and language, the pooled one last: whether it is a function word."""
        found = pc.fill_null(pc.index_in(names, value_set=self.known), len(self.known))
        return self.table[found.to_numpy()]


@dataclass
class Measures:
    """What is measured by block and page; languages are positions in the lexicon, the pooled one last."""

    language: np.ndarray
    words: np.ndarray
    prose: np.ndarray
    block: dict[str, np.ndarray]
    pairs: np.ndarray
    copies: np.ndarray
    page: dict[str, np.ndarray]
    page_words: np.ndarray
    in_line: np.ndarray
    is_top: np.ndarray
    chars: np.ndarray


def measure(t: Tokens, given: list, lexicon: Lexicon) -> Measures:
    """All measures of a slice; ``given`` has the delivered languages."""
    flags = lexicon.flags(t.names)
    width = len(t.names) + 1
    once = _sorted_once(t.doc.astype(np.int64) * width + t.code)
    doc, code = once // width, once % width
    pooled = len(lexicon.languages)
    best, guess = np.zeros(t.n, np.int64), np.full(t.n, pooled)
    for j in range(pooled):
        hits = np.bincount(doc[flags[code, j]], minlength=t.n)
        guess = np.where(hits > best, j, guess)
        best = np.maximum(best, hits)
    places = {language: j for j, language in enumerate(lexicon.languages)}
    told = np.array([places.get(g, pooled) for g in given], np.int64)
    # Where few function words tell, the delivered language counts.
    language = np.where((best >= TELLING) | ((told == pooled) & (best > 0)), guess, told)
    function = flags[t.code, language[t.doc]] if len(t.code) else np.zeros(0, bool)
    words = t.per_block(~t.number)
    every = np.maximum(t.per_block(np.ones(len(t.code))), 1)
    share = lambda mask: t.per_block(mask) / np.maximum(words, 1)
    distinct = _distinct_shares(t, words)
    seen = _word_times(t)
    block = {
        "function": t.per_block(function & ~t.number) / np.maximum(words, 1),
        "distinct": distinct,
        "word": share(recurring_phrases(t, 1, WORD_WINDOW, seen=seen)),
        "bigram": share(recurring_phrases(t, 2, PHRASE_WINDOW, seen=seen)),
        "trigram": share(recurring_phrases(t, 3, PHRASE_WINDOW, seen=seen)),
        "separator": (t.hard + t.soft) / every,
        "form": t.forms / every,
    }
    in_line = recurring_lines(t)
    chars = t.form_chars + t.per_doc(t.length)
    # The top word of a page is its most frequent word that is neither function word nor number, the first of them.
    able = np.flatnonzero(~t.number & ~function)
    top_times = np.zeros(t.n, np.int64)
    np.maximum.at(top_times, t.doc[able], seen[able])
    top = able[seen[able] == top_times[t.doc[able]]]
    top = top[_starts(t.doc[top])] if len(top) else top
    top_code = np.full(t.n, -1)
    top_code[t.doc[top]] = t.code[top]
    page_words = t.per_doc(~t.number)
    page = {"line": t.per_doc(t.length * in_line) / np.maximum(chars, 1), "top": top_times / np.maximum(page_words, 1)}
    is_top = (top_code[t.doc] == t.code) & ~t.number
    prose = (words >= PROSE) & (distinct >= DISTINCT)
    return Measures(language, words, prose, block, share(recurring_phrases(t, 1, WORD_WINDOW, 2, seen)), share(recurring_phrases(t, COPY, PHRASE_WINDOW, 2, seen)), page, page_words, in_line, is_top, chars)


def _records(t: Tokens, in_line: np.ndarray) -> np.ndarray:
    """By line: whether it is a record, a short line with a number, hardly separated and without forms, that does not recur."""
    lines = len(t.line_forms)
    numbers, words = np.bincount(t.line[t.number], minlength=lines), np.bincount(t.line[~t.number], minlength=lines)
    again = np.zeros(lines, bool)
    again[t.line[in_line]] = True
    return (numbers > 0) & (words <= RECORD_WORDS) & (t.line_forms == 0) & (t.line_separators < 3) & ~again


def junk_chars(t: Tokens, m: Measures, limits: np.ndarray) -> np.ndarray:
    """Junk characters per document; ``limits`` has a row per language and a column per measure of LIMITS."""
    at = {name: i for i, name in enumerate(LIMITS)}
    language = m.language[t.doc[t.first]] if t.blocks else np.zeros(0, np.int64)
    over = lambda name: m.block[name] >= limits[language, at[name]]
    poor = m.block["function"] < limits[language, at["function"]]
    line = t.line[t.first] if t.blocks else np.zeros(0, np.int64)
    lists = poor & ~_records(t, m.in_line)[line]
    separators = t.hard + t.soft
    _, which = np.unique(line, return_inverse=True)
    run = np.bincount(which, weights=m.words * poor)[which] if t.blocks else np.zeros(0)
    junk = lists & (over("trigram") | over("bigram"))
    junk |= lists & over("word") & (m.words >= LIST_WORDS)
    # A list is junk too if its words recur twice, but not as a copy of a list with separators.
    dense, bare = (separators >= 3) & over("separator"), separators <= 0.05 * m.words
    twice = np.where(dense, 0.5, np.where(m.words >= USUAL_BLOCK, 0.6, np.inf))
    junk |= lists & (m.pairs >= twice) & (m.copies < 0.5)
    junk |= lists & bare & (m.words >= USUAL_BLOCK) & (m.pairs >= 0.7)
    junk |= lists & (run >= LIST_RUN)
    junk |= (poor & (m.block["form"] >= FORMS[0])) | (m.block["form"] >= FORMS[1])
    junk |= (m.block["distinct"] < limits[language, at["distinct"]]) & (m.words >= USUAL_BLOCK)
    topped = (m.page["top"] > limits[m.language, at["top"]]) & (m.page_words >= USUAL_PAGE)
    has_top = t.per_block(m.is_top) > 0
    if t.blocks:
        junk |= lists & has_top & topped[t.doc[t.first]]
    lined = m.page["line"] > limits[m.language, at["line"]]
    marked = junk[t.block] | (m.in_line & lined[t.doc]) if len(t.code) else np.zeros(0, bool)
    return t.form_chars + t.per_doc(t.length * marked).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose last column, the text, has at most SLICE_BYTES, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield batch.slice(begin)


def _scan(docs: DataFrame, work: Callable[[pa.Array, list, Tokens], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on every slice of the documents, as (ids, delivered languages, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield work(part.column(0), part.column(1).to_pylist(), tokenise(part.column(2)))

    language = F.lower(F.trim(F.col("lang").cast("string")))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(~language.isin("", POOLED, UNDETERMINED), language).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _word_counts(ids: pa.Array, given: list, t: Tokens) -> pa.RecordBatch:
    """(lang, word, docs, prose, listed) of a slice; the row without a word has the totals."""
    # Pages of unknown language only count among all pages.
    languages = [None, *sorted({g for g in given if g is not None})]
    place = {g: i for i, g in enumerate(languages)}
    told = np.array([place[g] for g in given], np.int64)
    words = t.per_block(~t.number)
    distinct = _distinct_shares(t, words)
    prose = (words >= PROSE) & (distinct >= DISTINCT)
    loose = (words > 0) & ((words < PROSE) | (distinct < LOOSE))
    usable = ~t.number & (told[t.doc] > 0)
    width = len(t.names) + 1
    key = told[t.doc] * width + t.code
    in_prose, in_list = usable & prose[t.block], usable & loose[t.block]
    once = _sorted_once(t.doc[in_prose].astype(np.int64) * width + t.code[in_prose])
    seen, docs = np.unique(told[once // width] * width + once % width, return_counts=True)
    size = len(languages) * width
    of_prose, of_list = np.bincount(key[in_prose], minlength=size), np.bincount(key[in_list], minlength=size)
    langs = np.concatenate([seen // width, np.arange(len(languages))])
    totals = of_prose.reshape(-1, width).sum(1), of_list.reshape(-1, width).sum(1)
    pages = np.bincount(told, minlength=len(languages))
    word = pa.concat_arrays([t.names.take(pa.array(seen % width)), pa.nulls(len(languages), pa.string())])
    out = [
        pa.array(languages, pa.string()).take(pa.array(langs.astype(np.int64))), word, pa.array(np.concatenate([docs, pages]).astype(np.int64)),
        pa.array(np.concatenate([of_prose[seen], totals[0]]).astype(np.int64)), pa.array(np.concatenate([of_list[seen], totals[1]]).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(out, names=["lang", "word", "docs", "prose", "listed"])


def function_words(docs: DataFrame) -> dict[str, list[str]]:
    """The function words of every delivered language.

    A word must be in the prose of COMMON of its language's documents and CONTRAST times as
    frequent there as in its lists. So there are at most 1 / COMMON times the distinct words
    of an average document, and at most 1 / LANGUAGE_SHARE languages: few enough for the driver.
    """
    counts = _scan(docs, _word_counts, "lang string, word string, docs bigint, prose bigint, listed bigint")
    # Written once: a row per language and word.
    counts = materialize(counts.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("docs", "prose", "listed")]))
    totals = counts.where("word is null")
    pages = totals.agg(F.sum("docs")).collect()[0][0] or 0
    totals = totals.where((F.col("docs") >= LANGUAGE_SHARE * pages) & F.col("lang").isNotNull() & (F.col("prose") > 0))
    totals = {r["lang"]: {f"all_{c}": r[c] for c in ("docs", "prose", "listed")} for r in totals.collect()}
    if not totals:
        return {}
    rows = counts.where(F.col("word").isNotNull() & F.col("lang").isin(list(totals)))
    figure = lambda name: F.create_map(*[F.lit(x) for lang, r in totals.items() for x in (lang, float(r[name]))])[F.col("lang")]
    # A word that no list holds counts there as a part of an occurrence.
    rarely = (F.col("listed") + 0.1) / (figure("all_listed") + 100)
    chosen = rows.where((F.col("docs") >= COMMON * figure("all_docs")) & (F.col("prose") / figure("all_prose") >= CONTRAST * rarely))
    out: dict[str, list[str]] = {lang: [] for lang in totals}
    for r in chosen.select("lang", "word").collect():
        out[r["lang"]].append(r["word"])
    return {lang: sorted(words) for lang, words in out.items() if words}


def _histograms(lexicon: Lexicon) -> Callable[[pa.Array, list, Tokens], pa.RecordBatch]:
    def work(ids: pa.Array, given: list, t: Tokens) -> pa.RecordBatch:
        m = measure(t, given, lexicon)
        of_block = t.doc[t.first]
        says = m.words >= USUAL_BLOCK
        worded = m.block["function"] > 0
        lists = (m.words >= USUAL_LIST) & ~worded
        chosen = {name: (m.page[name], m.page_words >= USUAL_PAGE) for name in m.page}
        for name, mask in {"function": says & m.prose & worded, "distinct": says & worded, **dict.fromkeys(("word", "bigram", "trigram", "separator"), lists)}.items():
            # A page counts once, with the mean over its blocks.
            blocks = np.bincount(of_block[mask], minlength=t.n)
            chosen[name] = (np.bincount(of_block[mask], weights=m.block[name][mask], minlength=t.n) / np.maximum(blocks, 1), blocks > 0)
        keys, counts = [], []
        for i, name in enumerate(LIMITS):
            value, mask = chosen[name]
            bins = np.clip((value[mask] * BINS).astype(np.int64), 0, BINS - 1)
            key, n = np.unique((m.language[mask] * len(LIMITS) + i) * BINS + bins, return_counts=True)
            keys.append(key)
            counts.append(n)
        key = np.concatenate(keys)
        columns = [key // (len(LIMITS) * BINS), key // BINS % len(LIMITS), key % BINS, np.concatenate(counts)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["language", "measure", "bin", "n"])

    return work


def calibrate(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Thresholds by language (the pooled one last) and measure, from quantiles over all pages.

    A histogram has BINS bins for each language and measure, whatever the number of pages.
    """
    rows = _scan(docs, _histograms(lexicon), "language bigint, measure bigint, bin bigint, n bigint").groupBy("language", "measure", "bin").agg(F.sum("n")).collect()
    found = np.zeros((len(lexicon.languages) + 1, len(LIMITS), BINS))
    for language, name, at, n in rows:
        found[language, name, at] += n
    found[-1] = found.sum(0)
    limits = np.zeros(found.shape[:2])
    for j, (name, (part, way)) in enumerate(LIMITS.items()):
        for i in range(len(found)):
            total = found[i, j].cumsum()
            # The lower edge of the quantile's bin: a measure that is usually 0 counts as 0.
            usual = np.searchsorted(total, total[-1] * QUANTILE.get(name, 0.25)) / BINS if total[-1] else USUAL.get(name, 0.0)
            limits[i, j] = part * usual + way * (1 - usual)
    return limits


def spam_shares(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, n_chars, junk_chars, junk_share) of all documents with any character.

    ``docs`` has (doc_id, lang, text) and is read three times. ``lang`` is the language told
    by the function words, else the delivered one, else null. Null, empty and blank texts
    give no row. Every row counts, repeated texts and ids too; a null id is kept. White space
    is not counted, punctuation only within forms. Texts are judged whole. Other columns are
    ignored. An empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    lexicon = Lexicon(function_words(docs))
    sent = context.broadcast((lexicon, calibrate(docs, lexicon)))

    def work(ids: pa.Array, given: list, t: Tokens) -> pa.RecordBatch:
        lexicon, limits = sent.value
        m = measure(t, given, lexicon)
        junk = junk_chars(t, m, limits)
        names = pa.array([*lexicon.languages, None], pa.string()).take(pa.array(m.language))
        columns = [ids, names, pa.array(m.chars.astype(np.int64)), pa.array(junk.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "n_chars", "junk_chars"])

    rows = _scan(docs, work, "doc_id bigint, lang string, n_chars bigint, junk_chars bigint").where("n_chars > 0")
    return rows.withColumn("junk_share", F.col("junk_chars") / F.col("n_chars"))


def spam_pages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id) of the spam pages; see spam_shares()."""
    return spam_shares(docs).where(F.col("junk_share") > SPAM_SHARE).select("doc_id")


def page_measures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_lines, n_separators, form_chars, word_chars, top_word_n, bigram_words, trigram_words, line_words).

    The measures that need no calibration, of all documents: words without numbers, lines
    with words, the occurrences of the most frequent word, and the words that lie in
    recurring bigrams, trigrams and lines.
    """

    def work(ids: pa.Array, given: list, t: Tokens) -> pa.RecordBatch:
        width = len(t.names) + 1
        key, times = np.unique((t.doc.astype(np.int64) * width + t.code)[~t.number], return_counts=True)
        top = np.zeros(t.n, np.int64)
        np.maximum.at(top, key // width, times)
        first = np.flatnonzero(_starts(t.line)) if len(t.line) else np.zeros(0, np.int64)
        counts = [
            t.per_doc(~t.number), np.bincount(t.doc[first], minlength=t.n), t.separators, t.form_chars, t.per_doc(t.length), top,
            t.per_doc(recurring_phrases(t, 2, PHRASE_WINDOW)), t.per_doc(recurring_phrases(t, 3, PHRASE_WINDOW)), t.per_doc(recurring_lines(t)),
        ]
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int64)) for c in counts]], names=["doc_id", *names])

    names = ["n_words", "n_lines", "n_separators", "form_chars", "word_chars", "top_word_n", "bigram_words", "trigram_words", "line_words"]
    return _scan(docs, work, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in names))
