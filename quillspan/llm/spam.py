"""Keyword-stuffed and link-list pages.

All lags of a text are looked at, from 1 to its length:

* *Recurrence gaps.* For every word and every pair of words, the number of words since
  it stood last. An occurrence between two gaps that differ by no more than a factor
  ``EVEN`` recurs evenly, at the lag of the smaller gap.
* *Positional autocorrelation.* Lags are put in half-octaves. Around each place, in a
  window as wide as the lag, the share of words that recur evenly at about this lag is
  the autocorrelation there. Prose repeats "of the" at uneven gaps, so it stays near 0;
  a window whose share exceeds ``EXCESS`` is mechanical at that lag: the frame of a price
  list, "... in A, ... in B", or a cycle of keywords of any length.
* *Sentences.* A function word speaks for a sentence unless it recurs mechanically or
  stands in the title of one of the page's own links. A stretch of more than ``TURN``
  words that comes back word for word and holds function words is a sentence said again
  (a refrain), whatever its lag.
* *Lists.* Windows of ``WINDOW`` words with hardly any such function words are listed
  words. A record is a case if most of its words, apart from its source's repeated lines,
  are listed, if they are enough to tell (a sum of log-likelihood ratios, to which a high
  link density adds), and if they are regular, short items between separators, or
  distinct words without any uneven recurrence, as no language is written.

Lines that hold an unfilled placeholder or a line of a program's trace are residue, and
texts mostly of filler words are too: these are no lists.

Defined results: null and blank texts and texts of too few words to tell are no cases;
rows that repeat an id count once; null links and null density say nothing; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp
from . import residue_seeds
from .function_words import FUNCTION_WORDS
from .repeated_lines import clean_texts
from .residue import placeholder

U = np.uint64
WINDOW = 20
#: Share of function words up to which a window is no sentence; prose has 0.3 and more.
FUNCTION_SHARE = 0.12
#: Two gaps are even if neither is more than so many times the other.
EVEN = 2.0
#: Autocorrelation above which pairs, and single words, recur mechanically.
EXCESS, WORD_EXCESS = 0.22, 0.3
#: Where this share of the words are function words, as in prose, one frame must make up so much of the window.
WRITTEN, WRITTEN_EXCESS = 0.36, 0.38
#: Share of words, none a function word, that came back within a window, above which all of it is stuffed; prose has under 0.1.
STUFFED = 0.25
#: A sentence that is said again is longer than this, and has at least this share of function words.
TURN, SAID_SHARE = 4, 0.3
CASE_SHARE = 0.5
#: Log-likelihood ratio of listed against written words, of a word without and with a function; and of a page that is mostly links.
PLAIN_WORD, FUNCTION_WORD, LINK_PAGE, LINK_DENSITY, EVIDENCE = 0.5, -2.1, 2.0, 0.6, 5.0
#: Titles of links that make a list.
LEAST_TITLES = 3
#: Different filler words that make filler.
LEAST_FILLERS = 3
REGULAR_SHARE, ITEM_WORDS, UNEVEN_SHARE, FILLER_SHARE = 0.2, 6.0, 0.05, 0.3
# Characters that part listed items.
SEPARATORS = "\n\r,;|·•#/()[]<>»«-–—.:!?*"
#: A line of a program's trace: places in files by line, or calls.
TRACE = re.compile(r":\d+:\d+\)?\s*$|\bon line \d+|^\s*at [\w.$<>]+ ?\(|\bline \d+, in \w+|\w\.\w+\(\S*:\d+\)", re.I)


def hashes_of(words) -> np.ndarray:
    """The word hashes of :func:`codepoints.word_hashes` for given words."""
    text = " ".join(sorted(words))
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.unique(cp.word_hashes(cps, np.array([0, len(cps)]))[0])


@cache
def _function_hashes() -> np.ndarray:
    return hashes_of(FUNCTION_WORDS)


@cache
def _filler_hashes() -> np.ndarray:
    return hashes_of({*residue_seeds.LATIN_FILLER, *residue_seeds.KEYBOARD_FILLER} - FUNCTION_WORDS)


@cache
def _separators() -> np.ndarray:
    flags = np.zeros(cp.LAST + 1, bool)
    flags[[ord(c) for c in SEPARATORS]] = True
    return flags


def member(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return known[at] == words


def summed(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def around(x: np.ndarray, reach: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mean of x over the places up to ``reach`` away, within the bounds of the own text."""
    at = np.arange(len(x))
    a, z = np.maximum(at - reach, low), np.minimum(at + reach + 1, high)
    pre = summed(x)
    return (pre[z] - pre[a]) / np.maximum(z - a, 1)


def gaps(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the places since its key stood last and until it stands next; 0 where it does not."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    back, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = order[same + 1] - order[same]
    back[order[same + 1]] = step
    ahead[order[same]] = step
    return back, ahead


def mechanical(keys: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """Places whose key recurs evenly, where the autocorrelation at that lag exceeds the ``excess`` asked for there."""
    n = len(keys)
    back, ahead = gaps(keys)
    lag, most = np.minimum(back, ahead), np.maximum(back, ahead)
    even = (lag > 0) & (most <= EVEN * lag)
    # The outer two of three even occurrences recur as evenly as the one between them.
    centre = np.flatnonzero(even)
    lags = np.zeros(n, np.int64)
    lags[centre - back[centre]] = lags[centre + ahead[centre]] = lag[centre]
    lags[centre] = lag[centre]
    held = np.flatnonzero(lags)
    out = np.zeros(n, bool)
    if not len(held):
        return out
    octave = np.full(n, -9, np.int64)
    octave[held] = np.floor(2 * np.log2(lags[held])).astype(np.int64)
    for b in np.unique(octave[held]):
        near = np.abs(octave - b) <= 1
        own = np.flatnonzero(octave == b)
        reach = max(WINDOW // 2, int(np.ceil(2 ** ((b + 1) / 2))))
        pre = summed(near)
        a, z = np.maximum(own - reach, low[own]), np.minimum(own + reach + 1, high[own])
        out[own] = (pre[z] - pre[a]) >= excess[own] * (z - a)
    return out


def said_again(back: np.ndarray, ahead: np.ndarray, function: np.ndarray) -> np.ndarray:
    """Words of stretches of more than TURN words that come back word for word, at a longer lag, with function words."""
    out = np.zeros(len(back), bool)
    pre = summed(function)
    for gap in (back, ahead):
        far = gap > TURN
        # Pairs of one stretch stand at one lag, side by side.
        head = np.flatnonzero(far & ~np.r_[False, far[:-1] & (gap[1:] == gap[:-1])])
        if not len(head):
            continue
        last = np.flatnonzero(far & ~np.r_[far[1:] & (gap[1:] == gap[:-1]), False])
        a, z = np.maximum(head - 1, 0), last + 1
        kept = (z - a > TURN) & (pre[z] - pre[a] >= SAID_SHARE * (z - a))
        edge = np.zeros(len(back) + 1, np.int64)
        np.add.at(edge, a[kept], 1)
        np.add.at(edge, z[kept], -1)
        out |= np.cumsum(edge)[:-1] > 0
    return out


def titles(cps: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, anchors: pa.ListArray | None) -> tuple[np.ndarray, np.ndarray]:
    """Per word: whether an item begins with it; whether its item is worded like the title of one of its page's links."""
    n = len(words)
    parts = summed(_separators()[cp.clipped(cps)])
    begins = np.ones(n, bool)
    begins[1:] = (parts[start[1:]] > parts[end[:-1]]) | (text[1:] != text[:-1])
    if anchors is None or not len(anchors.flatten()):
        return begins, np.zeros(n, bool)
    flat = anchors.flatten()
    owner = np.repeat(np.arange(len(anchors)), np.diff(anchors.offsets.to_numpy())) if anchors.null_count == 0 else np.concatenate([np.full(len(a) if a is not None else 0, i, np.int64) for i, a in enumerate(anchors.to_pylist())])
    w, _, _, first = cp.word_hashes(*cp.code_points(flat))
    pre = cp.prefix(w)
    full = first[1:] > first[:-1]
    known = np.unique(cp.span_hash(pre, first[:-1][full], first[1:][full]) ^ cp.mix(owner[full].astype(U)))
    if not len(known):
        return begins, np.zeros(n, bool)
    found = np.zeros(n, bool)
    lines = np.r_[True, (summed((cps == 10) | (cps == 13))[start[1:]] > summed((cps == 10) | (cps == 13))[end[:-1]]) | (text[1:] != text[:-1])]
    pre = cp.prefix(words)
    for unit in (begins, lines):
        head = np.flatnonzero(unit)
        tail = np.r_[head[1:], n]
        same = member(cp.span_hash(pre, head, tail) ^ cp.mix(text[head].astype(U)), known)
        found |= np.repeat(same, tail - head)
    return begins, found


def judged(texts: pa.Array, anchors: pa.ListArray | None = None, density: np.ndarray | None = None) -> np.ndarray:
    """Whether each text is a case by its words; residue is not looked for here."""
    cps, off = cp.code_points(texts)
    words, start, end, first = cp.word_hashes(cps, off)
    n, count = len(words), np.diff(first)
    out = np.zeros(len(texts), bool)
    if not n:
        return out
    text = np.repeat(np.arange(len(texts)), count)
    low, high = first[:-1][text], first[1:][text]
    salt = cp.mix(text.astype(U))
    function = member(words, _function_hashes())
    pairs = cp.mix(np.r_[words[:1], words[:-1]] * U(0x9E3779B97F4A7C15) + words) ^ salt
    alone = np.flatnonzero(low == np.arange(n))
    pairs[alone] = cp.mix(alone.astype(U)) ^ U(1)
    back, ahead = gaps(pairs)
    written = around(function, WINDOW // 2, low, high) >= WRITTEN
    frame = mechanical(pairs, low, high, np.where(written, WRITTEN_EXCESS, EXCESS))
    again = said_again(back, ahead, function)
    own = words ^ salt
    regular = frame | np.r_[frame[1:] & (text[1:] == text[:-1]), False] | mechanical(own, low, high, np.where(written, 1.0, WORD_EXCESS))
    per = lambda x: np.diff(summed(x)[first])
    begins, linked = titles(cps, words, start, end, text, anchors)
    linked &= (per(linked & begins) >= LEAST_TITLES)[text]
    sentence = function & (again | ~(regular | linked))
    # Windows of WINDOW words, or the whole text where it is shorter, that start at each place.
    width = np.minimum(WINDOW, high - low)
    at = np.arange(n)
    whole = at + width <= high
    pre = summed(sentence)
    hot = whole & (pre[np.minimum(at + width, n)] - pre[at] <= FUNCTION_SHARE * width)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[hot], 1)
    np.add.at(edge, (at + width)[hot], -1)
    listed = np.cumsum(edge)[:-1] > 0
    gap, _ = gaps(own)
    fillers = member(words, _filler_hashes())
    # One word of the filler passage can be somebody's keyword.
    filler = per(fillers) * (per(fillers & (gap == 0)) >= LEAST_FILLERS)
    n_listed = per(listed)
    odds = PLAIN_WORD * n_listed + (FUNCTION_WORD - PLAIN_WORD) * per(listed & sentence)
    if density is not None:
        odds = odds + LINK_PAGE * (density > LINK_DENSITY)
    crowded = around((gap > 0) & (gap <= WINDOW) & ~function, WINDOW // 2, low, high) >= STUFFED
    stuffed = around(crowded, WINDOW // 2, low, high) > 0
    uneven = per(listed & (gap > 0) & ~regular)
    latin = per(listed & (cps[start] < 0x250))
    tells = (per(listed & (regular | stuffed | linked)) >= REGULAR_SHARE * n_listed) | (n_listed <= ITEM_WORDS * np.maximum(per(listed & begins), 1)) | ((uneven <= UNEVEN_SHARE * n_listed) & (latin >= 0.9 * n_listed))
    return (n_listed > 0) & (n_listed >= CASE_SHARE * count) & (odds >= EVIDENCE) & tells & (filler < FILLER_SHARE * np.maximum(count, 1))


def without_residue(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not TRACE.search(x) and not placeholder(x))


def is_spam(text: str | None, anchors: list[str] = (), density: float = 0.0) -> bool:
    """A text is a case if it is one as it stands and, where it holds lines of residue, without these as well."""
    if not text:
        return False
    links, dense = pa.array([list(anchors)], pa.list_(pa.string())), np.array([density])
    if not judged(pa.array([text], pa.string()), links, dense)[0]:
        return False
    left = without_residue(text)
    return left == text or bool(judged(pa.array([left], pa.string()), links, dense)[0])


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, anchors = batch.column(1), batch.column(2)
        density = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64))
        for a, z in cp.slices(texts):
            found = judged(texts.slice(a, z - a), _plain(anchors.slice(a, z - a)), density[a:z])
            keep = [a + i for i in np.flatnonzero(found) if is_spam(texts[a + i].as_py(), [x for x in anchors[a + i].as_py() or () if x], density[a + i])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], names=["id"])


def _plain(anchors: pa.ListArray) -> pa.ListArray:
    """The same lists from offset 0, null lists empty."""
    return pa.concat_arrays([anchors.fill_null([]) if anchors.null_count else anchors])


def spam_pages(df: DataFrame, id_col: str, source: Column, text_col: str, anchors: Column | None = None, density: Column | None = None) -> DataFrame:
    """(id): the keyword-stuffed and link-list pages. anchors: titles of a page's own links; density: share of its text in links."""
    links = F.lit(None).cast("array<string>") if anchors is None else anchors
    share = F.lit(None).cast("double") if density is None else density.cast("double")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), source.alias("source"), F.col(text_col).alias("text"), links.alias("anchors"), share.alias("density")).where("id is not null and text is not null")
    return clean_texts(rows, "id", F.col("source"), "text", ["anchors", "density"]).mapInArrow(_cases, "id bigint").distinct()
