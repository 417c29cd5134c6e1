"""Statistics of texts that tell running prose from lists, tables and junk.

The author's own text, without quoted passages and signature, is measured: words, symbols, line ends, common words, repeated
lines, paragraphs and word sequences. The shape of a line only says what it looks like and how much it weighs. What a text is,
combined rules over all statistics decide (``combined_kind``): repetition turns prose into junk, and so do words
that no language of the common words has together with marks where none belong; then the kind that weighs most wins.
"""

import re

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import written_at
from tagloom.sources.files import located

#: Part of the weight of a text that prose must not reach for the text to be a list, table or junk.
PROSE_PART = 0.5
#: Weight of a line besides its characters: items and rows are short.
LINE_WEIGHT = 12
#: Items or rows from which on they are a list or table; fewer are part of prose.
LEAST_ROWS = 3
#: Lines from which on short ones without mark are a list.
LEAST_ITEMS = 4
#: Repetition: more than this share of duplicate lines or paragraphs, or this share of the characters in one word sequence.
REPEATED, DOMINANT = 0.5, 0.4
#: No language: less than this share of common words, and at least so many marks within words for each word.
LEAST_COMMON, INNER_MARKS = 0.15, 0.08
#: Words from which on repetition of sequences, and the lack of a language, can be told.
SOME_WORDS, MANY_WORDS = 12, 10

_LINE_END = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
_QUOTE_TAG = re.compile(r"<(/?)blockquote\b[^<>\n]*>|\[(/?)quote\b[^\[\]\n]*\]", re.I)
_CLOSING = re.compile(r"[ \t]*(?:\n|$)|</blockquote>|\[/quote\]", re.I)
_QUOTED_LINE = re.compile(r"\s*(?:>|&gt;)")
_SAID = re.compile(r"\s*On\s.+\swrote\s*:\s*$")
_SIGNATURE = re.compile(r"\s*(?:--|__+|—)\s*$")
#: What makes a signature: so many lines below a mark, and characters, at most. More below a mark is text.
_SIGNATURE_LINES, _SIGNATURE_CHARS = 6, 400

_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
# Names of markup tags in square brackets.
_BRACKETS = "b|i|u|s|url|img|quote|code|list|size|color|center|spoiler|email|font|hr|br"
_TAG = re.compile(
    rf"</?[a-z][a-z0-9]*\b[^<>\n]*>|\[/?(?:{_BRACKETS})(?:=[^\[\]\n]*)?\]"
    r"|\{\{[^{}\n]*\}\}|&(?:[a-z]{2,8}|#\d{1,6});(?:[a-z]{2,8};)*",
    re.I,
)
_CELL_TAG = re.compile(r"</?t[rdh]\b[^<>\n]*>", re.I)
_ITEM_TAG = re.compile(r"\s*<li\b[^<>\n]*>", re.I)
_URL = re.compile(r"(?:https?|ftp)://\S+|www\.\S+", re.I)
_BULLET = re.compile(r"\s*(?:\[[ xX]?\]|[-*•·–—+‣◦▪●○]|->|=>|[#№]\s?\d{1,4}[.):]?|\(?\d{1,4}[.):]|\(?[A-Za-z]{1,2}[.)])(?:\s+|(?<=[•·‣◦▪●○]))(?=\S)")
_NO_LETTERS, _NO_ALNUM = re.compile(r"[\W\d_]+"), re.compile(r"[\W_]+")
_RULES = set("|-+:= \t│┼─┬┴├┤╪═┌┐└┘_")
# The same for ASCII, where deleting bytes is much faster.
_ASCII_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_ASCII_NO_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
_LOG = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|\w{3} +\d{1,2} \d\d:\d\d:\d\d)")
_HEX = re.compile(r"\s*(?:0x)?[0-9a-f]{4,16}:?\s+(?:[0-9a-f]{2,4}\s+){3,}", re.I)
#: What may part the fields of a row: a character that must be there, the rule to split by, and the least fields.
_COLUMNS = [
    (mark, re.compile(rule), least)
    for mark, rule, least in (
        ("|", r"\s*\|\s*", 2), ("│", r"\s*│\s*", 2), ("\t", r"\s*\t\s*", 2), (";", r"\s*;\s*", 2), ("!", r"\s+!\s+", 2),
        ("   ", r"\s{2,}", 2), (",", r",(?=\S)", 3),
    )
]
_PAIR = re.compile(r"[^\s:][^:\n]{0,28}[:=]\s+\S{1,16}(?:\s\S{1,6})?$")
#: A line of words, each with a mark behind it at most, and of small numbers before words: mostly no shape but that of a sentence.
_PLAIN = re.compile(
    r"(?:(?:\d{1,3} [^\W\d_]{3,23}|[^\W\d_]{1,23}(?:['’-][^\W\d_]{1,23})*)[.,?!'\";:]{0,2}(?: |$))+"
)
_INNER_MARK = re.compile(r"[,;](?<=[^\W\d_][,;])(?=[^\W\d_])")
_SENTENCE_END = re.compile(r"[.!?…。！？;:][\"'”’»)\]]*$")


def without_quotes(text: str) -> str:
    """``text`` without quoted passages, however nested, in tags or by line marks.

    A passage goes from an opening tag to the closing tag of its name that evens out those between; if there are too few, to
    the last one. Only closing tags at the end of a line, or right before another one, count. Tags without partner stay.
    """
    if "quote" in text.lower():
        text = _without_tagged(text)
    if ">" not in text and "&gt;" not in text:
        return text
    kept = []
    for line in text.split("\n"):
        if _QUOTED_LINE.match(line):
            while kept and not kept[-1].strip():
                kept.pop()
            if kept and _SAID.match(kept[-1]):
                kept.pop()
        else:
            kept.append(line)
    return "\n".join(kept)


def _without_tagged(text: str) -> str:
    tags = []
    for m in _QUOTE_TAG.finditer(text):
        name = "q" if m.group(0)[0] == "[" else "b"
        if not (m.group(1) or m.group(2)):
            tags.append((m.start(), m.end(), name, True))
        elif _CLOSING.match(text, m.end()):
            tags.append((m.start(), m.end(), name, False))
    # The partner of each opening tag, and the last closing tag of each name for those that have none.
    partner, last = {}, {}
    open_: dict[str, list[int]] = {"q": [], "b": []}
    for k, (_, _, name, opens) in enumerate(tags):
        if opens:
            open_[name].append(k)
        else:
            last[name] = k
            if open_[name]:
                partner[open_[name].pop()] = k
    pieces, at, k = [], 0, 0
    while k < len(tags):
        start, _, name, opens = tags[k]
        end = partner.get(k, last.get(name, -1)) if opens else -1
        if end > k:
            pieces.append(text[at:start])
            at, k = tags[end][1], end
        k += 1
    pieces.append(text[at:])
    return "\n".join(pieces)


_LINE_ENDS = "\r\x0b\x0c\x85\u2028\u2029"


def own_text(text: str) -> str:
    """The author's own text: without quoted passages, and without a signature below a mark."""
    if any(c in text for c in _LINE_ENDS):
        text = _LINE_END.sub("\n", text)
    lines = without_quotes(text).split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    for i in range(len(lines) - 1, max(-1, len(lines) - 2 - _SIGNATURE_LINES), -1):
        if _SIGNATURE.match(lines[i]):
            if sum(map(len, lines[i + 1 :])) <= _SIGNATURE_CHARS and (i + 1 < len(lines)):
                lines = lines[:i]
            break
    return "\n".join(lines).strip()


def _letters(s: str) -> int:
    if s.isascii():
        return len(s.encode().translate(None, _ASCII_NO_LETTERS))
    return len(_NO_LETTERS.sub("", s))


def _alnum(s: str) -> int:
    if s.isascii():
        return len(s.encode().translate(None, _ASCII_NO_ALNUM))
    return len(_NO_ALNUM.sub("", s))


def _dense(s: str) -> int:
    """Characters that are not blank."""
    return len("".join(s.split()))


def _cells(line: str) -> int:
    """Fields of a line that is a table row, else 0: at least two of a few words."""
    for mark, rule, least in _COLUMNS:
        if mark in line:
            cells = [c for c in rule.split(line.strip()) if c]
            if len(cells) >= least and all(len(c) <= 28 and c.count(" ") <= 2 for c in cells):
                return len(cells)
    return 0


def line_kind(line: str) -> str:
    """What one line of a text looks like: prose, list, table or junk; items, which is a list by itself; or rule, which is part of a table
    or else junk."""
    if _PLAIN.fullmatch(line) and not line[0].isdigit() and line[1:2] not in ".)" and line[2:3] not in ".)":
        # Short parts between semicolons may be fields or items, a short line with a colon a pair.
        if not (";" in line and (line.index(";") <= 28 or line.count("; ") >= LEAST_ITEMS - 1)) and not (":" in line and len(line) < 60):
            return "prose"
    return _shaped(line)


def _shaped(line: str) -> str:
    tags, bare = 0, line
    if "<" in line:
        if _CELL_TAG.search(line):
            return "table"
        if _ITEM_TAG.match(line):
            return "list"
    if "<" in line or "[" in line or "{" in line or "&" in line:
        bare, tags = _TAG.subn(" ", line)
    bare = bare.strip()
    if not bare or (tags >= 3 and _letters(bare) < 0.4 * _dense(line)):
        return "junk" if not _BULLET.match(line) or not bare else "list"
    if _LOG.match(bare) or _HEX.match(bare):
        return "junk"
    if bare[0] in _RULES and set(bare) <= _RULES and len(bare) > 2:
        return "rule"
    urls = "://" in bare or "www." in bare
    if urls and _letters(_URL.sub("", bare)) < 12:
        return "junk"
    if "»" in bare and bare.count("»") >= 3:
        return "junk"
    if _cells(bare):
        return "table"
    if bare.count("; ") >= LEAST_ITEMS - 1 and all(len(x.split()) <= 6 for x in bare.split(";")):
        return "items"
    item = _BULLET.match(line)
    if item:
        rest = line[item.end() :].strip()
        words = len(rest.split())
        if words and (words <= 9 or not _SENTENCE_END.search(rest)) and words <= 14:
            return "list"
    if (":" in bare or "=" in bare) and _PAIR.match(bare):
        return "list"
    letters = _letters(bare)
    dense = _dense(bare)
    if letters < 0.45 * dense and dense > 3:
        return "junk"
    longest = max(bare.split(), key=len)
    if len(longest) >= 24 and longest.isascii() and len(longest) > 0.6 * dense and not urls:
        return "junk"
    return "prose"


def _bare_items(lines: list[str], kinds: list[str]) -> list[str]:
    """``kinds`` with the items of a list without marks: short lines that nearly all begin with a capital or a number.

    In wrapped prose most lines begin within a sentence. Lines in capitals, and long lines, are no such items; nor are lines
    that all end in punctuation, such as short sentences.
    """
    prose = [i for i, k in enumerate(kinds) if k == "prose"]
    items = [
        i for i in prose if ((x := lines[i])[0].isupper() or x[0].isdigit()) and not x.isupper() and len(x) <= 60 and x.count(" ") <= 8
    ]
    inside = sum(x[0].islower() for i in prose if len(x := lines[i]) <= 60)
    open_ = sum(not _SENTENCE_END.search(lines[i]) for i in items)
    if len(items) < LEAST_ITEMS or len(items) < 0.8 * (len(prose) - 2) or 3 * open_ < len(items) or 10 * inside > len(prose):
        return kinds
    found = set(items)
    return ["list" if i in found else k for i, k in enumerate(kinds)]


_ASCII_BLANKS = bytes(b if chr(b).isalnum() or chr(b) in "'-" else 32 for b in range(128)) + bytes(range(128, 256))


def _words(text: str) -> list[str]:
    """The words of a text, in lower case."""
    text = text.lower()
    if not text.isascii():
        return _WORD.findall(text)
    text = text.encode().translate(_ASCII_BLANKS).decode()
    words = text.split()
    if "'" in text or "-" in text:
        return [x for w in words for x in ((w,) if w.isalnum() else _WORD.findall(w))]
    return words


_MIX, _ZERO = np.uint64(0x9E3779B97F4A7C15), np.zeros(1, np.int64)


def _dominant(words: list[str], letters: int) -> float:
    """Greatest share of the words' ``letters`` that one sequence of 2, 3 or 4 words covers; 0 for a sequence that stands once."""
    if len(words) < 4:
        return 0.0
    # Sequences are told apart by 64-bit hashes, each from that of the sequence before and the next word.
    n_words = len(words)
    ids = np.fromiter(map(hash, words), np.int64, n_words).view(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    grams, covered, best = ids, lengths, 0
    for n in (2, 3, 4):
        grams = grams[:-1] * _MIX + ids[n - 1 :]
        covered = covered[:-1] + lengths[n - 1 :]
        order = grams.argsort()
        ordered = grams[order]
        starts = np.flatnonzero(ordered[1:] != ordered[:-1])
        if len(starts) == len(grams) - 1:
            break  # then no longer sequence repeats either
        starts = np.concatenate((_ZERO, starts + 1))
        counts = np.diff(starts, append=len(grams))
        often = counts > 1
        best = max(best, int((counts[often] * covered[order[starts[often]]]).max()))
    return min(1.0, best / letters)


def combined_kind(weights: dict[str, float], s: dict) -> str:
    """The kind of a text of which lines of each shape have these weights, by the statistics ``s``.

    Prose that repeats itself is junk: in lines, in paragraphs, or in one sequence of words. So is prose without the words any language
    has, if marks stand within its words. A text is no prose if less than half of its weight is left for prose; then it is what
    weighs most.
    """
    w = dict(weights)
    repeated = max(s["duplicate_line_share"], s["duplicate_paragraph_share"]) > REPEATED or (
        s["dominant_share"] >= DOMINANT and s["n_words"] >= SOME_WORDS
    )
    noise = s["common_share"] < LEAST_COMMON and s["n_words"] >= MANY_WORDS and s["inner_mark_share"] >= INNER_MARKS
    if repeated or noise:
        w["junk"] += w["prose"]
        w["prose"] = 0.0
    if w["prose"] >= PROSE_PART * sum(w.values()):
        return "prose"
    return max(("list", "table", "junk"), key=w.get)


FIELDS = (
    "n_chars bigint, n_own_chars bigint, n_words bigint, mean_word_len double, symbol_ratio double, n_lines bigint, "
    "line_end_share double, common_share double, inner_mark_share double, duplicate_line_share double, "
    "duplicate_paragraph_share double, dominant_share double, prose_share double, list_share double, table_share double, junk_share double, kind string"
)


_NAMES = [x.partition(" ")[0] for x in FIELDS.split(", ")]
_CLOSERS = " \t\"')]”’»"
_ENDS = frozenset(".!?…。！？;:")
_BLANK = re.compile(r"\n\s*\n")


def _repeated(parts: list[str]) -> float:
    """Share of the characters in parts that stood before; 0 without parts."""
    once = set(parts)
    if len(once) == len(parts):
        return 0.0
    every = sum(map(len, parts))
    return (every - sum(map(len, once))) / every


def text_statistics(text: str | None, common: frozenset[str] = frozenset()) -> tuple:
    """The values of ``FIELDS`` of one text.

    ``n_chars`` is of the whole text, all else of the author's own. Words are runs of letters and digits outside markup, in lower case.
    ``symbol_ratio`` is the part of non-blank characters that are neither letters nor digits; ``line_end_share`` that of non-empty lines
    that end in punctuation; ``common_share`` that of words in ``common``; ``inner_mark_share`` the number of commas and semicolons
    between letters, for each word. Duplicate shares are by characters, of all but the first of equal lines or paragraphs.
    Shares of shapes are those of the lines' weights. Null has null counts; without own words, lines or characters a ratio is 0.
    ``kind`` is prose, list, table or junk, null for null and blank texts.
    """
    if text is None:
        return (None,) * len(_NAMES)
    own = own_text(text)
    lines = [x for x in map(str.strip, own.split("\n")) if x]
    if not lines:
        return (len(text), 0, 0, *[0.0] * 2, 0, *[0.0] * 10, None)
    bare = _TAG.sub(" ", own) if any(c in own for c in "<[{&") else own
    words = _words(bare)
    dense = _dense(own)
    weights = dict.fromkeys(("prose", "list", "table", "junk"), 0.0)
    kinds = [line_kind(line) for line in lines]
    ruled = "table" if kinds.count("table") + kinds.count("rule") > kinds.count("rule") * 2 else "junk"
    kinds = _bare_items(lines, [ruled if k == "rule" else k for k in kinds])
    few = {k for k in ("list", "table") if kinds.count(k) < LEAST_ROWS}
    for line, found in zip(lines, kinds):
        # Fields of few rows, but many of them, are items.
        if found == "table" and "table" in few and line.count("; ") >= LEAST_ITEMS - 1:
            found = "items"
        weights["list" if found == "items" else "prose" if found in few else found] += len(line) + LINE_WEIGHT
    total = sum(weights.values())
    n, letters = len(words), sum(map(len, words))
    s = {
        "n_chars": len(text), "n_own_chars": len(own), "n_words": n, "mean_word_len": letters / n if n else 0.0,
        "symbol_ratio": (dense - _alnum(own)) / dense, "n_lines": len(lines),
        "line_end_share": sum(x.rstrip(_CLOSERS)[-1:] in _ENDS for x in lines) / len(lines),
        "common_share": sum(map(common.__contains__, words)) / n if n else 0.0,
        "inner_mark_share": len(_INNER_MARK.findall(bare)) / n if n and ("," in bare or ";" in bare) else 0.0,
        "duplicate_line_share": _repeated(lines),
        "duplicate_paragraph_share": _repeated([p for p in map(str.strip, _BLANK.split(own)) if p]) if "\n" in own else 0.0,
        "dominant_share": _dominant(words, letters), **{f"{k}_share": weights[k] / total for k in weights},
    }
    s["kind"] = combined_kind(weights, s)
    return tuple(s[x] for x in _NAMES)


def common_path(common_words: DataFrame) -> str:
    """Where the words of a table (``lang, word``), of any language, in lower case, lie in the shared folder: texts mix languages and
    ``lang`` may be wrong. Workers read them from there, once each; the driver never has them."""
    return written_at(common_words.select(F.lower("word").alias("word")).where("word is not null").distinct())


def _common_at(path: str) -> frozenset[str]:
    """The words below a path; kept with the worker process, as functions are unpickled for each task."""
    kept = sys.modules.setdefault("_tagloom_kept", types.ModuleType("_tagloom_kept")).__dict__
    if f"words {path}" not in kept:
        fs, inner = located(path)
        kept[f"words {path}"] = frozenset(pads.dataset(inner, filesystem=fs, format="parquet").to_table()["word"].to_pylist())
    return kept[f"words {path}"]


def statistics_column(text: Column, common: frozenset[str] | str = frozenset()) -> Column:
    """A struct of ``FIELDS`` for each text; see ``text_statistics``. Common words are given themselves or as ``common_path``."""
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types_ = [kinds[x.partition(" ")[2]] for x in FIELDS.split(", ")]

    def measure(texts: pa.Array) -> pa.Array:
        words = _common_at(common) if isinstance(common, str) else common
        rows = [text_statistics(t, words) for k in range(0, len(texts), 500) for t in texts.slice(k, 500).to_pylist()]
        columns = list(zip(*rows)) or [()] * len(_NAMES)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types_)], names=_NAMES)

    measure.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Not deterministic for the optimizer, which else measures the texts that a filter on the result keeps a second time.
    struct = f"struct<{', '.join(': '.join(x.split(' ')) for x in FIELDS.split(', '))}>"
    return F.arrow_udf(measure, struct).asNondeterministic()(text)


def text_counts(text: Column) -> dict[str, Column]:
    """Of whole texts, by built-in expressions: characters, lines, words (what blanks part), share of lines that end in ``.``, ``!`` or ``?``,
    and share of lines that stood before. Null for null texts; shares are 0 without lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t\r]"))
    n = F.size(lines)
    share = lambda x: F.when(n > 0, x / n).otherwise(F.when(n == 0, F.lit(0.0)))
    return {
        "n_chars": F.length(text).cast("bigint"),
        "n_lines": F.when(text.isNotNull(), n).cast("bigint"),
        "n_words": F.when(text.isNotNull(), F.size(F.filter(F.split(text, "[ \t\r\n]+"), lambda x: x != ""))).cast("bigint"),
        "line_end_share": F.when(text.isNotNull(), share(F.size(F.filter(lines, lambda x: x.rlike("[.!?][ \t\r]*$"))))),
        "duplicate_share": F.when(text.isNotNull(), share(n - F.size(F.array_distinct(lines)))),
    }
