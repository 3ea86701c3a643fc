"""Template residue, filler, error pages and notices that scripts are needed.

Two character n-gram models are fitted, of residue (seed sentences of filler, error
notices and script notices) and of natural prose (all texts of the corpus without their
repeated lines, and sentences that only speak of such things). The logarithm of their likelihood ratio,
averaged over windows of characters, localises residue; windows in which a model of
filler leads are told apart from notices. A record is excluded

* if notices and filler cover enough of its text, apart from the source's repeated lines, or
* if one run of filler is long enough, wherever it stands, or
* if it holds an unfilled placeholder that is not quoted.

Defined results: null and blank texts are no cases; a text of nothing but repeated
lines is none either; rows that repeat an id count once; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import cycle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import codepoints as cp
from . import residue_seeds as seeds
from .repeated_lines import clean_texts

U = np.uint64
ORDERS = (5, 3, 2)
BITS = {5: 19, 3: 16, 2: 12}
#: Where the table of each order starts in a tally; the last cell of a tally counts characters.
STARTS = {5: 0, 3: 1 << 19, 2: (1 << 19) + (1 << 16)}
CELLS = sum(1 << b for b in BITS.values())
#: Characters to which the counts of a larger corpus are brought, so that smoothing weighs alike at any size.
SCALE = 2_700_000
#: Share of residue from which the first fit leaves a text out of the second.
SPOILT = 0.2
#: Words of a task that are counted before they are passed on.
WORDS = 200_000
#: Defaults of :func:`natural_sample`.
SAMPLE, LEAST_CHARS = 2000, 600
#: Widths of the windows, with the mean log-likelihood ratio per character above which a window is residue.
NOTICE_WINDOWS = {48: 0.55, 24: 0.9}
FILLER_WINDOWS = {48: 0.6}
COVERAGE = 0.35
#: Characters of one run of filler that make a case in any surroundings.
FILLER_RUN = 90

# Names of variables that every shell has; ${HOME} is no unfilled placeholder.
SHELL_NAMES = "HOME|PATH|USER|PWD|SHELL|LANG|HOSTNAME|TMPDIR|EDITOR|PORT"
# What templates have slots for. A name is made of these, whatever joins them: first_name, firstName, "First name".
SLOTS = frozenset(
    "name first last middle full user nick company customer client member business brand city town country state region street address zip post email mail phone tel fax mobile date day month year time "
    "price amount total cost currency product item sku order invoice title subject heading headline subtitle tagline slogan caption summary excerpt intro description text body content copy message note quote "
    "author editor writer sender recipient image img photo picture logo icon alt link url href page site website domain blog event venue location place number num id key category tag keyword topic "
    "greeting signature line job position role department f l m placeholder value variable field param".split()
)
#: Elements of a page's own markup that share their name with a slot; in angle brackets these are markup.
MARKUP = frozenset("time caption section code label button".split())
#: Delimiters of two or more signs, which prose never has in pairs: opening, what may stand inside, closing.
INSIDE = r"[^\n{}<>\[\]]{0,60}?"
COMPOUND = [
    rf"\{{\{{[{{#^/>&!~\-]?\s*[A-Za-z$]{INSIDE}\}}\}}",
    rf"\{{%[-+]?\s*[A-Za-z]{INSIDE}%\}}",
    rf"\{{#\s*[A-Za-z]{INSIDE}#\}}",
    r"<%[=\-#@]?\s*[A-Za-z$@][^\n%]{0,60}?%>",
    r"<\?(?:php|=)?\s*\$?[A-Za-z][^\n?]{0,60}?\?>",
    rf"[$#]\{{(?!(?:{SHELL_NAMES})\}})\s*[A-Za-z]{INSIDE}\}}",
    r"\[\[\s*[A-Za-z][\w.\-: ]{0,40}?\s*\]\]",
    r"\[%[-+]?\s*[A-Za-z][^\n\]]{0,40}?%\]",
    r"\*\|[A-Za-z][\w:.\- ]{0,40}\|\*",
    r"@@[A-Za-z][\w.\-]{0,40}@@",
    r"(?<![\w_])__[A-Z][A-Z0-9_]{1,40}?__(?![\w_])",
]
#: Words that only a template addresses to its user.
PHRASES = [
    r"\[(?:[Yy]our|YOUR|[Ii]nsert|INSERT|[Ee]nter|[Aa]dd|ADD|[Tt]ype) [\w\-. ]{1,40}\]",
    r"\[[\w\-. ]{1,40} (?:here|HERE|goes here)\]",
    r"(?<!\w)[xX]{3} [\w\-. ]{1,40}? [xX]{3}(?!\w)",
    r"(?<!\w)(?:TODO|FIXME)\s*:\s*(?:add|insert|fill|write|put|replace)\b",
    r"(?<!\w)INSERT [A-Z][A-Z\-. ]{0,40} HERE(?!\w)",
]
#: Names in capitals between signs that prose uses singly, indexes, and names of several parts in angle brackets.
CAPITALS = [
    r"(?<![\w%])%[A-Z][A-Z0-9_\-]{2,40}%(?!\w)",
    r"(?<![\w#])#[A-Z][A-Z0-9_]{1,40}#(?![\w#])",
    r"(?<![\w{$])\{(?:\d{1,2}|[A-Z][A-Z0-9]*_[A-Z0-9_]+)\}(?![\w}])",
    r"<[a-z]+(?:[-_][a-z]+)+>",
]
CERTAIN = re.compile("|".join(f"(?:{p})" for p in COMPOUND + PHRASES + CAPITALS))
#: One sign on either side: a placeholder only if slots make up the name.
NAMED = re.compile(r"(?<![\w{$#%])\{\$?([A-Za-z][\w.\- ]{0,40})\}(?![\w}])|<([A-Za-z][\w.\- ]{0,40})>|(?<!\[)\[([A-Za-z][\w.\- ]{0,40})\](?![\](])|(?<![\w$])\$([A-Za-z][\w.\-]{0,40})\$(?![\w$])|(?<![\w%])%([A-Za-z][\w.\-]{0,40})%(?![\w%])|(?<!\()\(\(\s*([A-Za-z][\w.\- ]{0,40}?)\s*\)\)(?!\))")
#: A cheap test that every placeholder passes.
HINT = r"\{|<[A-Za-z%?]|\$[A-Za-z{]|%[A-Za-z]|\[|\(\(|[xX]{3} |TODO|FIXME|INSERT |__[A-Z]|@@|#[A-Z{]|\*\|"
QUOTES = "`'\"´‘’“”„«»"


def slot(name: str) -> bool:
    """Whether a name is made of the words that templates have slots for, in one word or in several."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return bool(parts) and all(p.isdigit() or _made(p.lower()) for p in parts) and not parts[0].isdigit()


def _made(word: str) -> bool:
    """One slot word, or two of three letters or more joined as in "firstname"."""
    return word in SLOTS or any(word[:k] in SLOTS and word[k:] in SLOTS for k in range(1 if word[:1] in "flm" else 3, len(word) - 2))


def found(text: str) -> Iterator[tuple[int, int]]:
    """Where placeholders stand, quoted or not."""
    for m in CERTAIN.finditer(text):
        yield m.span()
    for m in NAMED.finditer(text):
        name = next(g for g in m.groups() if g is not None)
        if slot(name) and not (m.group(2) and name in MARKUP):
            yield m.span()


def placeholder(text: str) -> bool:
    """Whether a placeholder stands in the text that is neither in quotes nor in a stretch of code between backticks."""
    for start, end in found(text):
        before, after = text[max(0, start - 8) : start].rstrip(" ")[-1:], text[end : end + 40]
        line = text[text.rfind("\n", 0, start) + 1 : start]
        code = line.count("`") % 2 and "`" in text[end:].split("\n", 1)[0]
        if not code and not (before and before in QUOTES and any(q in after for q in QUOTES)):
            return True
    return False


def _symbols() -> np.ndarray:
    """Code point -> lower case, digits alike, all blanks alike."""
    t = cp.tables()
    s = t["lower"].astype(U)
    s[t["number"]] = ord("0")
    for i in (9, 10, 11, 12, 13, 133, 160, 8239, 0x2007):
        s[i] = 32
    return cp.mix(s + U(77))


_cached: list[np.ndarray] = []


def symbols(cps: np.ndarray) -> np.ndarray:
    if not _cached:
        _cached.append(_symbols())
    return _cached[0][cp.clipped(cps)]


def gram_slots(sym: np.ndarray) -> dict[int, np.ndarray]:
    """For each order n, the table slot of the n-gram that ends at each position (0 before the first)."""
    pre = cp.prefix(sym)
    out = {}
    for n in ORDERS:
        g = (cp.gram_hash(pre, n) >> U(64 - BITS[n])).astype(np.int64)
        out[n] = np.concatenate([np.zeros(min(n - 1, len(sym)), np.int64), g])[: len(sym)]
    return out


@dataclass
class Model:
    """Per kind of residue and order, the log-likelihood ratio of each n-gram; NaN where neither side saw it."""

    ratios: dict[str, dict[int, np.ndarray]]

    def score(self, slots: dict[int, np.ndarray], kind: str) -> np.ndarray:
        out = np.zeros(len(slots[ORDERS[0]]), np.float32)
        for n in reversed(ORDERS):
            r = self.ratios[kind][n][slots[n]]
            out = np.where(np.isnan(r), out, r)
        return out


def _counts(texts: list[str]) -> tuple[dict[int, np.ndarray], int]:
    joined = " \n ".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = gram_slots(symbols(cps))
    return {n: np.bincount(slots[n], minlength=1 << BITS[n]).astype(np.float64) for n in ORDERS}, len(cps)


def inside(off: np.ndarray, n: int, order: int) -> np.ndarray:
    """Which of n positions end an n-gram that lies whole within its text."""
    out = np.ones(n, bool)
    for k in range(order - 1):
        out[off[:-1][off[:-1] + k < off[1:]] + k] = False
    return out


def tally(texts: pa.Array) -> np.ndarray:
    """How often each n-gram stands within the texts, the orders one after the other, and the number of characters.
    Tallies are whole numbers, so those of parts add up to that of all in any order."""
    out = np.zeros(CELLS + 1, np.int64)
    for a, z in cp.slices(texts):
        cps, off = cp.code_points(texts.slice(a, z - a))
        slots = gram_slots(symbols(cps))
        out[CELLS] += len(cps)
        for n in ORDERS:
            out[STARTS[n] : STARTS[n] + (1 << BITS[n])] += np.bincount(slots[n][inside(off, len(cps), n)], minlength=1 << BITS[n])
    return out


def long_words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]{5,}", text.lower()))


def rare_limit(texts: int) -> int:
    """Texts that a rare word stands in at most."""
    return max(3, texts // 400)


def _kinds(rare: Iterable[str], seed: int) -> dict[str, list[str]]:
    """Seed texts by kind; every slot for a name takes the next rare word, from the first again after the last."""
    r = random.Random(seed)
    rare = list(rare)
    supply = cycle(rare)
    used: list[str] = []
    drawn: list[str] = []

    def name() -> str:
        drawn.append(next(supply) if rare else "name")
        return drawn[-1]

    def named(s: str) -> str:
        def one(_: re.Match) -> str:
            used.append(name())
            return used[-1]

        return re.sub("~", one, s)

    def words(vocabulary: list[str], n: int, mixed: float) -> str:
        picked = [name() if rare and r.random() < mixed else r.choice(vocabulary) for _ in range(n)]
        return " ".join(picked).capitalize() + "."

    filler = [words(seeds.LATIN_FILLER, r.randint(6, 16), 0) for _ in range(700)] + [words(seeds.KEYBOARD_FILLER, r.randint(4, 16), 0.12) for _ in range(500)]
    filler += [" ".join(named(s) for s in r.choices(seeds.FILLER, k=2)) for _ in range(900)]
    notice = [named(s) for _ in range(12) for s in seeds.SCRIPTS]
    for _ in range(14):
        for s in seeds.ERRORS:
            notice.append(named(r.choice(seeds.OPENERS) + r.choice([" ", ". ", ": ", "! "]) + s + " " + r.choice(seeds.CLOSERS)))
    return {"filler": filler, "notice": notice, "talk": [named(s) for _ in range(20) for s in seeds.TALK], "names": used, "drawn": drawn}


def _model(corpus: np.ndarray, kinds: dict[str, list[str]]) -> Model:
    """The models, from the tally of natural prose and the seed texts."""
    scale = min(1.0, SCALE / max(1, int(corpus[CELLS])))
    talk, size = _counts(kinds["talk"] * 4)
    size += int(corpus[CELLS]) * scale
    # The names filled into seeds are known to the other side at the same rate, so that they speak for neither.
    names, _ = _counts(kinds["names"])
    rate = size / max(1, sum(map(len, kinds["notice"])))
    natural = {n: corpus[STARTS[n] : STARTS[n] + (1 << BITS[n])] * scale + talk[n] + rate * names[n] for n in ORDERS}
    ratios = {}
    for kind in ("filler", "notice"):
        own, n_own = _counts(kinds[kind])
        ratios[kind] = {}
        for n in ORDERS:
            slots = float(1 << BITS[n]) / 8
            ratio = np.log((own[n] + 0.5) / (n_own + 0.5 * slots)) - np.log((natural[n] + 0.5) / (size + 0.5 * slots))
            # An n-gram of no seed that is rarer than one in twice SCALE characters leaves the decision to its shorter ones.
            ratios[kind][n] = np.where((own[n] > 0) | (natural[n] >= 0.5), np.clip(ratio, -4, 4), np.nan).astype(np.float32)
    return Model(ratios)


def fit(texts: list[str], seed: int = 5) -> Model:
    """The models. texts: the whole corpus; those that a first fit finds full of residue are left out of the second."""
    seen: dict[str, int] = {}
    for t in texts:
        for w in long_words(t):
            seen[w] = seen.get(w, 0) + 1
    rare = sorted((w for w, n in seen.items() if n <= rare_limit(len(texts))), key=lambda w: (md5(w.encode()).hexdigest(), w))
    kinds = _kinds(rare, seed)
    corpus = tally(pa.array(texts, pa.large_string()))
    first = _model(corpus, kinds)
    return _model(corpus - tally(pa.array([t for t in texts if spoilt(first, t)], pa.large_string())), kinds)


def windows(score: np.ndarray, levels: dict[int, float]) -> np.ndarray:
    """Characters that lie in a window whose mean score is above its level."""
    n = len(score)
    out = np.zeros(n, bool)
    if not n:
        return out
    pre = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    for width, level in levels.items():
        width = min(width, n)
        hot = (pre[width:] - pre[:-width]) > level * width
        edge = np.zeros(n + 1, np.int32)
        edge[: len(hot)] += hot
        edge[width : width + len(hot)] -= hot
        out |= np.cumsum(edge)[:n] > 0
    return out


def coverage(model: Model, text: str) -> tuple[float, float, int]:
    """Share of the visible characters in notices, in filler, and the longest run of filler."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = gram_slots(symbols(cps))
    visible = (cps > 32) & (cps != 160)
    total = max(1, int(visible.sum()))
    filler = windows(model.score(slots, "filler"), FILLER_WINDOWS)
    notice = windows(model.score(slots, "notice"), NOTICE_WINDOWS)
    edge = np.flatnonzero(np.diff(np.r_[False, filler, False].astype(np.int8)))
    longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
    return float((notice & visible).sum() / total), float((filler & visible).sum() / total), longest


def spoilt(model: Model, text: str) -> bool:
    return max(coverage(model, text)[:2]) >= SPOILT


def is_residue(model: Model, text: str) -> bool:
    if not text or not text.strip():
        return False
    if placeholder(text):
        return True
    notice, filler, longest = coverage(model, text)
    return longest >= FILLER_RUN or notice >= COVERAGE or filler >= COVERAGE


#: Texts up to the widest window are always scored alone; in longer ones a residue window shows when texts are joined as well.
SHORT = max(*NOTICE_WINDOWS, *FILLER_WINDOWS)
# Joined sums differ from those of one text by rounding.
SLACK = 1e-6


def _near(model: Model, texts: pa.Array) -> np.ndarray:
    """Which texts may hold a residue window. They are scored joined, with the n-grams that would reach over a border
    left out as in one text alone; short ones may always."""
    lower = lambda levels: {w: level - SLACK for w, level in levels.items()}
    cps, off = cp.code_points(texts)
    slots = gram_slots(symbols(cps))
    for n in ORDERS:
        slots[n][~inside(off, len(cps), n)] = 0
    hot = windows(model.score(slots, "filler"), lower(FILLER_WINDOWS)) | windows(model.score(slots, "notice"), lower(NOTICE_WINDOWS))
    return (np.diff(np.concatenate([[0], np.cumsum(hot)])[off]) > 0) | (np.diff(off) <= SHORT)


def _cases(model: Model):
    """Texts that are short, may hold a residue window or a placeholder are judged alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, z in cp.slices(texts):
                part = texts.slice(a, z - a)
                near = _near(model, part)
                hint = pc.match_substring_regex(part, HINT).fill_null(False).to_numpy(zero_copy_only=False)
                keep = []
                for i in np.flatnonzero(near | hint):
                    t = part[i].as_py()
                    if is_residue(model, t) if near[i] else placeholder(t):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).take(pa.array(keep, pa.int64()))], names=["id"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): texts that hold each long word, in parts that add up."""
    seen: dict[str, int] = {}
    rows = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
    for batch in batches:
        for t in batch.column(1):
            for w in long_words(t.as_py() or ""):
                seen[w] = seen.get(w, 0) + 1
            if len(seen) > WORDS:
                yield rows()
                seen.clear()
    yield rows()


def _tallied(batches: Iterator[pa.RecordBatch], chosen=None) -> Iterator[pa.RecordBatch]:
    """(cell, n): the tally of a task's texts, or of the chosen ones, without empty cells."""
    out = np.zeros(CELLS + 1, np.int64)
    for batch in batches:
        texts = batch.column(1)
        out += tally(texts if chosen is None else chosen(texts))
    cells = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(out[cells])], names=["cell", "n"])


def _spoilt(model: Model):
    def run(texts: pa.Array) -> pa.Array:
        keep = []
        for a, z in cp.slices(texts):
            keep += [a + i for i in np.flatnonzero(_near(model, texts.slice(a, z - a))) if spoilt(model, texts[a + i].as_py() or "")]
        return texts.take(pa.array(keep, pa.int64()))

    return run


def _summed(parts: DataFrame) -> np.ndarray:
    """The tally of all tasks; the driver gets a row a cell at most, 7 MB whatever the corpus."""
    sums = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS + 1, np.int64)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out


def fit_corpus(clean: DataFrame, seed: int = 5) -> Model:
    """:func:`fit` on all texts of (id, text), with the same result however they are spread."""
    words = clean.mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rare = words.where(F.col("n") <= rare_limit(clean.count()))
    # The seeds have so many slots for names; each is filled with another of all rare words.
    slots = len(_kinds(["name"], seed)["drawn"])
    kinds = _kinds([r.word for r in rare.orderBy(F.md5("word"), "word").limit(slots).collect()], seed)
    corpus = _summed(clean.mapInArrow(lambda b: _tallied(b), "cell int, n bigint"))
    shared = _Shared(clean.sparkSession, _model(corpus, kinds))
    return _model(corpus - _summed(clean.mapInArrow(lambda b: _tallied(b, _spoilt(shared.get())), "cell int, n bigint")), kinds)


def natural_sample(df: DataFrame, id_col: str, text_col: str, size: int = SAMPLE) -> list[str]:
    """For reading only, no model is fitted on it: at most ``size`` whole texts of LEAST_CHARS characters or more, chosen
    by the hash of their id, the same on every run. Rows are thinned by that hash to about twice the size before the floor."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    share = min(1.0, 2 * size / max(1, df.count()))
    thin = rows.where(F.col("h") < int(2**64 * share) - 2**63) if share < 1 else rows
    long = thin.where(F.length("text") >= LEAST_CHARS).select("h", "text")
    return [r.text for r in long.orderBy("h", "text").limit(size).collect()]


class _Shared:
    """The model as a broadcast variable: 2.5 MB, whatever the corpus."""

    def __init__(self, spark, model: Model):
        self.value = spark.sparkContext.broadcast({k: {n: a.tobytes() for n, a in r.items()} for k, r in model.ratios.items()})
        self.model: Model | None = None

    def __getstate__(self):
        return {"value": self.value, "model": None}

    def get(self) -> Model:
        if self.model is None:
            self.model = Model({k: {n: np.frombuffer(b, np.float32) for n, b in r.items()} for k, r in self.value.value.items()})
        return self.model


def residue_pages(df: DataFrame, id_col: str, source: Column, text_col: str) -> DataFrame:
    """(id): the records whose text consists of residue, or still holds it."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), source.alias("source"), F.col(text_col).alias("text")).where(r"id is not null and text is not null and text rlike '\\S'")
    # Read four times: for words, for n-grams, for the texts left out of the second fit and for the cases.
    clean = materialise(clean_texts(rows, "id", F.col("source"), "text"), "clean")
    shared = _Shared(df.sparkSession, fit_corpus(clean))
    return clean.mapInArrow(lambda b: _cases(shared.get())(b), "id bigint").distinct()
